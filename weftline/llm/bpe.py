"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a text has one BPE encoding, so it has one last token. Going left to right, the
last token of prefix i is the one vocabulary entry t ending at i for which the last token of the
prefix before t and t may stand side by side, that is, for which merging their joined bytes gives
just these two. Back-pointers from the end give the ids. The work is linear in the text
times the few vocabulary entries that end at a place, however long a piece is."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from itertools import chain

# Fixed value: the public splitting pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"
CACHE_PIECES = 400_000


def byte_letters() -> dict[str, int]:
    """The letters by which the vocabulary file writes bytes: printable Latin-1 bytes are themselves, the others follow from
    code point 256 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Encoder of one vocabulary file (JSON with vocab and merges)."""

    def __init__(self, path: str = DEFAULT_PATH):
        import ahocorasick
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = byte_letters()
        raw = {"".join(chr(letters[c]) for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.split_pieces = regex.compile(PATTERN).findall
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.birth: dict[int, int] = {}  # at which merge a token comes into being; -1 for bytes
        vocab = model["vocab"]
        for i in range(256):
            if chr(i) in raw:
                self.birth[raw[chr(i)]] = -1
        for n, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b, c = vocab.get(left), vocab.get(right), vocab.get(left + right)
            if a is None or b is None or c is None:
                continue
            self.rank.setdefault((a, b), n)
            if c not in self.birth:
                self.birth[c], self.parts[c] = n, (a, b)
        # one automaton of all entries that merging can give: in a single pass it names, for each place, the entries ending there
        self.automaton = ahocorasick.Automaton()
        for t, i in raw.items():
            if i in self.birth and self._whole(t, i):
                self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, list[int]] = {}
        self._stretches: dict[str, list[int]] = {}

    def _whole(self, text: str, token: int) -> bool:
        """Whether an entry is what merging makes of its own bytes: its parts must be compatible up to its own merge."""
        return token not in self.parts or self._compatible(*self.parts[token], self.birth[token])

    def _compatible(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether merging the bytes of a and b, using merges before limit, leaves a and b apart.

        While the two are built up from bytes, the border sees the right edge of a and the left edge
        of b at growing sizes. A merge across the border would win if it comes before the merges
        that next change either edge. Going backwards: the later-born edge is split first; a
        border pair whose merge is earlier than the split edge's end of life breaks the two."""
        while True:
            n = self.rank.get((a, b))
            if n is not None and n < limit:
                return False
            born_a, born_b = self.birth[a], self.birth[b]
            if born_a < 0 and born_b < 0:
                return True
            # a merge rule works from left to right: inside a it comes before the border and inside b
            # after it, so a border merge of the same rule loses to a's and wins over b's
            if born_a > born_b:
                limit, a = born_a, self.parts[a][1]
            else:
                limit, b = born_b + 1, self.parts[b][0]

    def compatible(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > CACHE_PIECES:
                self._pairs.clear()
            known = self._pairs[a, b] = self._compatible(a, b)
        return known

    def piece(self, text: str) -> list[int]:
        """Ids of one piece of the splitting pattern."""
        raw = text if text.isascii() else text.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(raw)
        last: list[int] = [-1] * (n + 1)
        length = [0] * (n + 1)
        known = self._pairs
        for end, (size, token) in self.automaton.iter(raw):
            end += 1
            if length[end]:
                continue
            start = end - size
            if start:
                if not length[start]:
                    continue
                fits = known.get((last[start], token))
                if fits is None:
                    fits = self.compatible(last[start], token)
                if not fits:
                    continue
            last[end], length[end] = token, size
        ids = []
        at = n
        while at:
            ids.append(last[at])
            at -= length[at]
        ids.reverse()
        return ids

    def _pieces_of(self, text: str) -> list[int]:
        known, out = self._pieces, []
        for p in self.split_pieces(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= 64:
                    if len(known) > CACHE_PIECES:
                        known.clear()
                    known[p] = ids
            out += ids
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; [] for null and the empty text. Strings that look like special tokens are ordinary text.

        Pieces never reach over a single space before a visible character, so text is taken in
        stretches from one such space to the next and their ids are kept; stretches at
        several spaces in a row are joined first."""
        if not text:
            return []
        stretches = text.split(" ")
        known = self._stretches
        found = list(map(known.get, stretches[1:]))
        if not stretches[0] or stretches[0][-1].isspace():
            return self._pieces_of(text)
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            s = stretches[at + 1]
            if not s or s[0].isspace() or s[-1].isspace():
                return self._pieces_of(text)
            ids = found[at] = self._pieces_of(" " + s)
            if len(s) <= 64:
                if len(known) > CACHE_PIECES:
                    known.clear()
                known[s] = ids
        return [*self._pieces_of(stretches[0]), *chain.from_iterable(found)]

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        return [self.encode(t) for t in texts]


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str = DEFAULT_PATH) -> PrefixEncoder:
    """The worker's encoder of a vocabulary file, built once per worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(os.fspath(path))
    return _ENCODERS[path]
