"""Text as column expressions: tokens, shingles, sentences, quantities, titles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing in a query, a title, or a keyword list.
QUERY_STOP = ["a", "after", "an", "and", "are", "as", "at", "be", "by", "could", "for", "from", "has", "have", "in", "is", "it", "its", "new", "of", "on", "over", "said", "says", "that", "the", "this", "to", "will", "with", "would"]
TITLE_STOP = ["a", "after", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "its", "new", "of", "on", "over", "say", "says", "that", "the", "this", "to", "with"]
# Verbs of attribution, and the patterns of claims.
ATTRIBUTION = ["said", "says", "told", "announced", "reported", "confirmed", "denied", "claimed", "stated", "warned", "argued", "added", "wrote", "disclosed", "acknowledged", "alleged", "estimated", "projected", "declined"]
NEGATION = r"\b(not|no|never|denied|denies|deny|without|rejects?|rejected)\b"
HEDGE = r"\b(may|might|could|reportedly|allegedly|appears?|seems?|expected to|is set to|plans? to|according to)\b"
DATE_HINT = r"\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|may|june|july|august|september|october|november|december|today|yesterday|this week|last week|next week|\d{4})\b"
QUANTITY = r"(\d[\d,]*(?:\.\d+)?)\s*(percent|%|billion|million|trillion|bn|jobs|gigawatts?|people|positions)"
UNIT_ALIASES = {"%": "percent", "bn": "billion", "gigawatt": "gigawatts", "position": "jobs", "positions": "jobs", "people": "jobs"}
# Separators before a masthead, and lower-case words that a masthead may have.
TITLE_SEPARATORS = [" | ", " — ", " – ", " - ", " · ", " :: "]
MASTHEAD_WORDS = ["a", "an", "and", "at", "de", "du", "for", "in", "la", "le", "of", "on", "the"]


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, as the variable of a one-element transform, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def normalize_whitespace(x: Column) -> Column:
    """Runs of white space to one space, ends trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def tokens(x: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))


def normalize_for_hash(x: Column) -> Column:
    return F.array_join(tokens(x), " ")


def token_set(x: Column) -> Column:
    return F.array_distinct(tokens(x))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def char_shingles(x: Column, size: int = 4) -> Column:
    """Distinct runs of size characters without spaces, case kept; a short text is one shingle, an empty one none."""
    def runs(c: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (size - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(size)))
        return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.length(c) <= size, F.array(c)).otherwise(F.array_distinct(each))

    return bound(F.replace(F.coalesce(x, F.lit("")), F.lit(" "), F.lit("")), runs)


def truncate(x: Column, limit: int) -> Column:
    """White space normalised; longer texts are cut and end with an ellipsis."""
    t = normalize_whitespace(x)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…")))


def strip_html(x: Column) -> Column:
    return normalize_whitespace(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]+>", " "))


def split_sentences(x: Column) -> Column:
    """Split after . ! ? and white space before a capital letter, bracket or quotation mark; no empty sentences."""
    return F.filter(F.split(normalize_whitespace(x), r"(?<=[.!?])\s+(?=[A-Z(\"'])"), lambda s: s != "")


def body_text(title: Column, excerpt: Column) -> Column:
    """Title as a sentence, then the excerpt."""
    t = F.coalesce(title, F.lit(""))
    stop = F.when(t.rlike(r"[.!?]$") | (t == ""), t).otherwise(F.concat(t, F.lit(".")))
    return F.trim(F.concat(stop, F.lit(" "), F.coalesce(excerpt, F.lit(""))))


def strip_site_suffix(title: Column) -> Column:
    """Up to two trailing mastheads dropped. A masthead is up to five words, capitalised but for a few, without digits or sentence
    marks; the headline before it keeps three words and 15 characters at least."""
    word = r"(?:[A-Z][^\s\d.!?%:;,\"']*|(?:" + "|".join(MASTHEAD_WORDS) + r")(?=\s|$)|[^\sA-Za-z\d.!?%:;,\"'][^\s\d.!?%:;,\"']*)"
    separators = "(?:" + "|".join(s.strip().replace("|", r"\|") for s in TITLE_SEPARATORS) + ")"
    tail = rf"^(.*\S)\s+{separators}\s+({word}(?:\s+{word}){{0,4}})$"

    def once(t: Column) -> Column:
        head = F.regexp_extract(t, tail, 1)
        last = F.regexp_extract(t, tail, 2)
        ok = t.rlike(tail) & (F.size(F.split(F.trim(head), r"\s+")) >= 3) & (F.length(F.trim(head)) >= 15) & ~last.rlike(rf"(^|\s){separators}(\s|$)") & last.rlike("[A-Za-z]")
        return F.when(ok, F.trim(head)).otherwise(t)

    return once(once(F.trim(F.coalesce(title, F.lit("")))))


def title_score(tokens_a: Column, tokens_b: Column, shingles_a: Column, shingles_b: Column) -> Column:
    """Half the Jaccard similarity of tokens and half that of four-letter shingles."""
    return 0.5 * jaccard(tokens_a, tokens_b) + 0.5 * jaccard(shingles_a, shingles_b)


def quantities(x: Column) -> Column:
    """array<struct<unit, value>> of the numbers with a unit, distinct and sorted."""
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(QUANTITY), F.lit(0))

    def one(m: Column) -> Column:
        unit = F.regexp_extract(m, r"([a-z%]+)$", 1)
        renamed = unit
        for k, v in UNIT_ALIASES.items():
            renamed = F.when(unit == k, F.lit(v)).otherwise(renamed)
        return F.struct(renamed.alias("unit"), F.regexp_replace(F.regexp_extract(m, r"^(\d[\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double").alias("value"))

    return F.array_sort(F.array_distinct(F.filter(F.transform(found, one), lambda s: s["value"].isNotNull())))


def has_pattern(x: Column, pattern: str) -> Column:
    return F.coalesce(x, F.lit("")).rlike("(?i)" + pattern)


def query_words(title: Column, limit: int = 7) -> Column:
    """The first content words of a title, as a user would type them."""
    return F.slice(F.filter(tokens(title), lambda t: ~t.isin(QUERY_STOP)), 1, limit)
