"""Words of a text without markup, shared by the operators on words (Python stage)."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"<(?:!--.*?--|/?[A-Za-z][^<>]*|![^<>]*|\?[^<>]*)>", re.S)
_DROP = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff]")
_LINK = re.compile(r"(?<=\])\((?:https?:|#|/)[^)\s]*\)|https?://\S+")
_WORD = re.compile(r"[^\W_]+")


def plain_text(text: str, links: bool = True) -> str:
    """The text without tags, entities and invisible characters, in compatibility form; link targets are dropped."""
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m.group(0)[1:3].lower() in ("b>", "i>") or re.match(r"</?(?:b|i|em|strong|a|span|u|sup|sub|font|mark|code)\b", m.group(0), re.I) else " ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _DROP.sub("", unicodedata.normalize("NFKC", text))
    return _LINK.sub(" ", text) if links and ("http" in text or "](" in text) else text


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits of the plain text; [] for null. Apostrophes inside a word join it."""
    if not text:
        return []
    t = plain_text(text)
    t = t.replace("’", "'") if not t.isascii() else t
    if "'" in t:
        t = re.sub(r"(?<=[^\W_])'(?=[^\W_])", "", t)
    return _WORD.findall(t.lower())
