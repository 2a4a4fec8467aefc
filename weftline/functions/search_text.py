"""Query strings and explanations of hits as column expressions; request parameters as plain values."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import text as T

MAX_RECORDS = 250
EXCERPT = 280
SHARED_TERMS = 8
_SPAN = re.compile(r"^\s*(\d+)\s*([a-z]+)\s*$", re.I)
# Units of time spans in minutes; a month is 30 days.
SPAN_MINUTES = {"min": 1, "mins": 1, "minutes": 1, "h": 60, "hour": 60, "hours": 60, "d": 1440, "day": 1440, "days": 1440, "w": 10080, "week": 10080, "weeks": 10080, "m": 43200, "month": 43200, "months": 43200}


def parse_query(query: str | None) -> tuple[list[str], list[list[str]]]:
    """(terms, phrases) of a query: what stands in double quotes is a phrase, everything else terms that must all occur."""
    token = lambda x: re.findall(r"[a-z0-9']+", x.lower())
    q = query or ""
    phrases = [t for t in map(token, re.findall(r'"([^"]*)"', q)) if t]
    return token(re.sub(r'"[^"]*"', " ", q)), phrases


def matches(text: Column, terms: list[str], phrases: list[list[str]]) -> Column:
    """Whether a text has all terms and all phrases, word for word; an empty query matches nothing."""
    if not terms and not phrases:
        return F.lit(False)

    def held(t: Column) -> Column:
        joined = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
        out = F.lit(True)
        for x in terms:
            out = out & F.array_contains(t, x)
        for p in phrases:
            out = out & joined.contains(" " + " ".join(p) + " ")
        return out

    return T.bound(T.tokens(text), held)


def term_overlap(query: Column, text: Column) -> Column:
    """Shared tokens of more than two letters, sorted, the first eight."""
    return F.slice(F.array_sort(F.filter(F.array_intersect(T.token_set(query), T.token_set(text)), lambda x: F.length(x) > 2)), 1, SHARED_TERMS)


def best_sentence(query: Column, text: Column) -> Column:
    """The sentence that shares most tokens with the query, the shorter of equals, then the first; cut at 280 letters. Null for a text without sentences."""

    def best(ss: Column) -> Column:
        scored = F.transform(ss, lambda s, i: F.struct((-F.size(F.array_intersect(T.token_set(query), T.token_set(s)))).alias("o"), F.length(s).alias("n"), i.alias("i"), s.alias("s")))
        return F.get(F.array_sort(scored), F.lit(0))["s"]

    return T.bound(T.split_sentences(text), lambda ss: F.when(F.size(ss) > 0, T.truncate(best(ss), EXCERPT)))


def explain(signals: Column, terms: Column) -> Column:
    """One line: the signals (a map of name to number) by size, the largest first, then the shared terms."""
    ranked = F.transform(F.array_sort(F.transform(F.map_entries(signals), lambda e: F.struct((-F.abs(e["value"])).alias("a"), e["key"].alias("k"), e["value"].alias("v")))), lambda e: F.concat(e["k"], F.lit("="), F.format_number(e["v"], 3)))
    return F.concat_ws("; ", F.array_join(ranked, ", "), F.when(F.size(terms) > 0, F.concat(F.lit("shares "), F.array_join(terms, ", "))))


def longest_title(titles: Column) -> Column:
    """The title with most tokens, the shorter of equals, then by name: what a story is called."""
    return F.get(F.array_sort(F.transform(titles, lambda t: F.struct((-F.size(T.token_set(t))).alias("n"), F.length(t).alias("l"), t.alias("t")))), F.lit(0))["t"]


def parse_timespan(span: str) -> dt.timedelta:
    """'15min', '24h', '7d', '2w', '1m' ... as a length of time; anything else is an error."""
    m = _SPAN.match(span or "")
    if not m or m.group(2).lower() not in SPAN_MINUTES:
        raise ValueError(f"not a time span: {span!r}")
    return dt.timedelta(minutes=int(m.group(1)) * SPAN_MINUTES[m.group(2).lower()])


def window_params(start: dt.datetime, end: dt.datetime) -> dict[str, str]:
    """A window as the article list takes it, in UTC."""
    return {k: t.astimezone(dt.timezone.utc).strftime("%Y%m%d%H%M%S") for k, t in (("startdatetime", start), ("enddatetime", end))}


def request_params(query: str, records: int = MAX_RECORDS, timespan: str | None = None, window: tuple[dt.datetime, dt.datetime] | None = None) -> dict[str, str]:
    """Parameters of an article-list request: records are at most 250, and an explicit window takes the place of a time span."""
    out = {"query": query, "mode": "artlist", "format": "json", "maxrecords": str(max(1, min(records, MAX_RECORDS))), "sort": "datedesc"}
    if window:
        return out | window_params(*window)
    if timespan:
        parse_timespan(timespan)
        out["timespan"] = timespan
    return out


def cache_key(model: str, version: str, text: Column) -> Column:
    """Key under which the vector of a text by a model is kept."""
    return F.sha2(F.concat_ws("\u001f", F.lit(model), F.lit(version), F.coalesce(text, F.lit(""))), 256)
