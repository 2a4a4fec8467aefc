"""Headlines in canonical words, and whether two are the same headline."""

from __future__ import annotations

import re
from functools import lru_cache

from weftline.llm.cleaning import plain_text

# Labels that news desks put before a headline, words that carry no news, and short forms of units.
LABELS = ["breaking", "breaking news", "just in", "exclusive", "video", "watch", "update", "updated", "live", "live updates", "developing", "alert", "photos", "photo", "pictures", "listen", "gallery", "podcast", "correction", "corrected", "urgent", "flash", "recap", "read", "new", "first on", "wrapup", "factbox", "analysis", "explainer", "audio"]
FILLERS = ["today", "now", "reportedly", "just", "also", "still", "very", "really", "apparently", "allegedly", "says", "report", "officially", "finally", "yesterday", "currently", "a", "an", "the", "and", "at", "by", "for", "from", "in", "into", "is", "its", "of", "on", "that", "to", "with", "as", "it", "are", "be", "has", "have", "was", "were", "will"]
FILLERS_ABROAD = ["el", "la", "los", "las", "un", "una", "de", "del", "en", "y", "le", "les", "des", "du", "une", "et", "au", "aux", "l", "d", "der", "die", "das", "den", "dem", "ein", "eine", "am", "im", "und", "zum", "zur"]
UNITS = {"m": "million", "mn": "million", "mln": "million", "mio": "millionen", "bn": "billion", "bln": "billion", "b": "billion", "tn": "trillion", "k": "thousand", "pct": "percent", "pc": "percent", "mw": "megawatt", "gw": "gigawatt", "kw": "kilowatt", "megawatts": "megawatt", "gigawatts": "gigawatt", "yr": "year", "yrs": "year", "years": "year", "mo": "month", "mos": "month", "mth": "month", "months": "month", "wk": "week", "wks": "week", "weeks": "week", "hr": "hour", "hrs": "hour", "hours": "hour", "days": "day", "d": "day", "min": "minute", "mins": "minute", "minutes": "minute"}
PLACEHOLDERS = ["", "untitled", "no title", "title", "none", "null", "n a", "na", "unknown", "nan", "tbd", "headline", "no headline", "undefined", "default"]

_LABEL = re.compile(r"^\W*(?:%s)(?: ?\d{1,2})?(?:\s*[:\])|–—·]+\s*|\s*-+\s*)" % "|".join(sorted(map(re.escape, LABELS), key=len, reverse=True)), re.I)
_END_LABEL = re.compile(r"\s*[(\[|–—-]\s*(?:%s)\s*[)\]]?\W*$" % "|".join(map(re.escape, ["video", "photos", "watch", "live", "updated", "exclusive", "update"])), re.I)
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|%")
_NO_NEWS = {*FILLERS, *FILLERS_ABROAD}
_LONG_FILLERS = {n: [f for f in FILLERS if len(f) >= 5 and abs(len(f) - n) <= 1] for n in range(4, 1 + max(map(len, FILLERS)) + 1)}  # by the length of the word that may be one with a slip


def slip(a: str, b: str) -> bool:
    """Whether one word is the other with a slip of typing: one letter left out, doubled or added, or two neighbours swapped. Another letter in the
    same place makes another word, and so does any change to a short word or a number."""
    n, m = len(a), len(b)
    if min(n, m) < 3 or max(n, m) < 4 or abs(n - m) > 1 or a[0].isdigit() or b[0].isdigit():
        return False
    if n == m:
        i = next((i for i in range(n) if a[i] != b[i]), n)
        return i + 1 < n and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :]
    if n > m:
        a, b, n, m = b, a, m, n
    i = next((i for i in range(n) if a[i] != b[i]), n)
    return a[i:] == b[i + 1 :]


def two_slips(a: str, b: str) -> bool:
    """Whether a longer word differs by two slips: in every way of dropping a letter of one, the rest is one slip away."""
    if min(len(a), len(b)) < 6 or abs(len(a) - len(b)) > 2 or a[0].isdigit() or b[0].isdigit():
        return False
    if len(a) < len(b):
        a, b = b, a
    if len(set(a) - set(b)) > 2 or len(set(b) - set(a)) > 1:  # letters of one side only: one for each slip
        return False
    return any(slip(a[:i] + a[i + 1 :], b) for i in range(len(a))) if len(a) > len(b) else sorted(a) == sorted(b) and sum(x != y for x, y in zip(a, b)) <= 4 and any(slip(a[:i] + a[i + 1] + a[i] + a[i + 2 :], b) for i in range(len(a) - 1))


@lru_cache(200_000)
def slipped_filler(w: str) -> bool:
    return any(slip(w, f) for f in _LONG_FILLERS.get(len(w), ()))


class Headlines:
    """Canonical words of headlines, given the mastheads that may stand at their ends."""

    def __init__(self, mastheads: list[str]):
        names = {tuple(w for w in _TOKEN.findall(m.casefold()) if w not in _NO_NEWS) for m in mastheads if m}
        self.mastheads = {n for n in names if n}
        self.sizes = sorted({len(n) for n in self.mastheads}, reverse=True)
        self.by_size = {k: [n for n in self.mastheads if len(n) == k] for k in self.sizes}
        self.first: dict[str, list[tuple[str, ...]]] = {}
        for n in self.mastheads:
            self.first.setdefault(n[-1], []).append(n)
        self.near: dict[str, list[list[tuple[str, ...]]]] = {}

    def _near(self, word: str) -> list[list[tuple[str, ...]]]:
        """Mastheads whose last word is this one with a slip, kept by word."""
        found = self.near.get(word)
        if found is None:
            if len(self.near) > 200_000:
                self.near.clear()
            found = self.near[word] = [ns for w, ns in self.first.items() if slip(word, w)]
        return found

    def _masthead(self, tail: tuple[str, ...]) -> bool:
        if tail in self.mastheads:
            return True
        return any(all(x == y or slip(x, y) for x, y in zip(tail, n)) for n in self.first.get(tail[-1], []) if len(n) == len(tail)) or (
            any(len(n) == len(tail) and n[:-1] == tail[:-1] for ns in self._near(tail[-1]) for n in ns) if len(tail[-1]) > 3 else False
        )

    def words(self, title: str | None) -> list[str]:
        """Canonical words; [] for a missing or placeholder headline."""
        if not title:
            return []
        t = plain_text(title).strip()
        for _ in range(3):
            cut = _END_LABEL.sub("", _LABEL.sub("", t, count=1))
            if cut == t:
                break
            t = cut
        t = t.casefold().replace("’", "'")
        if " ".join(_TOKEN.findall(t)) in PLACEHOLDERS:
            return []
        out = []
        after_number = False
        for w in _TOKEN.findall(re.sub(r"'s\b|'", "", t)):
            if w[0].isdigit():
                out.append(w.replace(",", "") if re.fullmatch(r"\d{1,3}(?:,\d{3})+", w) else w)
                after_number = True
                continue
            if w == "%":
                w = "percent"
            elif after_number and w in UNITS:
                w = UNITS[w]
            after_number = False
            if w not in _NO_NEWS:
                out.append(w)
        for k in self.sizes:
            if len(out) >= k + 3 and self._masthead(tuple(out[-k:])):
                out = out[:-k]
                break
            if len(out) >= k + 3 and tuple(out[:k]) in self.mastheads and re.match(r"^\W*(?:the )?%s\s*[:|–—-]" % r"\W+".join(out[:k]), t):
                out = out[k:]
                break
        return out


def same_headline(a: list[str], b: list[str], slips: int = 3) -> bool:
    """Whether two lists of canonical words are one headline: word for word equal or slipped, the numbers equal; a slipped filler
    or a word cut in two may stand on one side."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2:
        return False
    if len(a) == len(b):
        apart = [(x, y) for x, y in zip(a, b) if x != y]
        if len(apart) <= slips and all(slip(x, y) or two_slips(x, y) for x, y in apart):
            return True
    if [w for w in a if w[0].isdigit()] != [w for w in b if w[0].isdigit()]:
        return False
    if "".join(a) == "".join(b):
        return True
    c, d = [w for w in a if not slipped_filler(w)], [w for w in b if not slipped_filler(w)]
    if (len(c) < len(a) or len(d) < len(b)) and len(c) == len(d):
        return sum(x != y for x, y in zip(c, d)) <= slips and all(x == y or slip(x, y) for x, y in zip(c, d))
    if len(a) != len(b):  # one word in two pieces, or two run together
        s, l = (a, b) if len(a) < len(b) else (b, a)
        i = next((i for i, (x, y) in enumerate(zip(s, l)) if x != y and not slip(x, y)), len(s))
        return len(l) - len(s) == 1 and i < len(s) and (s[i] == l[i] + l[i + 1] or slip(s[i], l[i] + l[i + 1])) and len(s[i + 1 :]) == len(l[i + 2 :]) and all(x == y or slip(x, y) for x, y in zip(s[i + 1 :], l[i + 2 :]))
    return False
