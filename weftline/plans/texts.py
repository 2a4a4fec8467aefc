"""Queries on single texts: tokens, hashes, sentences, addresses, claims' marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.hashing import simhash64
from weftline.functions.urls import DOUBLE_SUFFIXES, TENANT_HOSTS, TRACKING_NAMES, TRACKING_PREFIXES, canonicalize_url, extract_domain, normalize_language
from weftline.sources.tables import table


def articles(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Articles, each once although some were delivered twice."""
    a = table(spark, d, "articles")
    return (a.select(*dict.fromkeys(("id", *cols))) if cols else a).dropDuplicates(["id"])


def tokens(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("title"))
    return articles(spark, d, "title").select("id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("normalized"))


def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "title", "excerpt")
    return a.select("id", F.sha2(T.normalize_for_hash(F.col("title")), 256).alias("title_hash"), F.sha2(T.normalize_for_hash(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("excerpt", F.lit("")))), 256).alias("text_hash"))


def body_texts(spark: SparkSession, d: str) -> DataFrame:
    b = T.body_text(F.col("title"), F.col("excerpt"))
    return articles(spark, d, "title", "excerpt").select("id", F.length(b).alias("n_chars"), T.truncate(b, 80).alias("short"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = T.split_sentences(F.col("excerpt"))
    return articles(spark, d, "excerpt").select("id", F.size(s).alias("n_sentences"), F.coalesce(F.get(s, F.lit(0)), F.lit("")).alias("first_sentence"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    t = T.strip_html(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(t).alias("n_chars_plain"), F.size(T.tokens(t)).alias("n_tokens"))


def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "url").select("id", canonicalize_url(F.col("url")).alias("canonical_url"))


def url_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ai_models").select("rec_id", extract_domain(F.col("url")).alias("url_domain"))


def lang_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(normalize_language(F.col("lang")).alias("language")).agg(F.count(F.lit(1)).alias("docs"))


def site_suffixes(spark: SparkSession, d: str) -> DataFrame:
    s = T.strip_site_suffix(F.col("title"))
    return articles(spark, d, "title").select("id", s.alias("headline"))


def quantities(spark: SparkSession, d: str) -> DataFrame:
    q = articles(spark, d, "title").select("id", F.explode(T.quantities(F.col("title"))).alias("q"))
    return q.select("id", F.col("q.unit").alias("unit"), F.col("q.value").alias("value"))


def claim_flags(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("excerpt")
    attributed = F.exists(T.tokens(x), lambda t: t.isin(T.ATTRIBUTION))
    return articles(spark, d, "excerpt").select("id", T.has_pattern(x, T.NEGATION).alias("negated"), T.has_pattern(x, T.HEDGE).alias("hedged"), T.has_pattern(x, T.DATE_HINT).alias("dated"), attributed.alias("attributed"))


def simhashes(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "title").select("id", simhash64(T.tokens(F.col("title"))).alias("simhash"))


def query_words(spark: SparkSession, d: str) -> DataFrame:
    q = articles(spark, d, "title").filter(F.col("id") % 20 == 0).select("id", T.query_words(F.col("title")).alias("w"))
    return q.filter(F.size("w") >= 4).select("id", F.array_join("w", " ").alias("query"))


def recency_weights(spark: SparkSession, d: str) -> DataFrame:
    age = F.greatest(F.lit(0.0), (F.lit(1790000000.0) - F.unix_seconds(F.col("published_at").cast("timestamp")).cast("double")) / 3600.0)
    return table(spark, d, "documents").select("doc_id", F.round(F.coalesce(F.pow(F.lit(0.5), age / 48.0), F.lit(1.0)), 6).alias("weight"))


QUERIES = {f.__name__: f for f in (tokens, text_hashes, body_texts, sentence_split, html_text, url_canonical, url_domain, lang_normalize, site_suffixes, quantities, claim_flags, simhashes, query_words, recency_weights)}

A = "(SELECT DISTINCT ON (id) * FROM articles)"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9'']+')"


def ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"


def quoted(xs: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


BODY = "trim((CASE WHEN coalesce(title, '') = '' OR regexp_matches(title, '[.!?]$') THEN coalesce(title, '') ELSE title || '.' END) || ' ' || coalesce(excerpt, ''))"
HASH64 = "(CASE WHEN ('0x' || substr(sha256({x}), 1, 16))::UBIGINT::HUGEINT >= 9223372036854775808 THEN ('0x' || substr(sha256({x}), 1, 16))::UBIGINT::HUGEINT - 18446744073709551616 ELSE ('0x' || substr(sha256({x}), 1, 16))::UBIGINT::HUGEINT END)::BIGINT"


def simhash_sql(source: str, key: str, text: str) -> str:
    """(key, simhash) of the rows of source, for joins with those that have tokens."""
    return f"""(WITH t AS (SELECT {key}, unnest({tok(text)}) AS w FROM {source}),
  h AS (SELECT {key}, ('0x' || substr(sha256(w), 1, 16))::UBIGINT AS u FROM t),
  b AS (SELECT {key}, i, sum(CASE WHEN (u >> i) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM h, (SELECT unnest(range(0, 64))::UBIGINT AS i) GROUP BY ALL),
  u AS (SELECT {key}, sum(CASE WHEN s > 0 THEN (1::HUGEINT << i::INT) ELSE 0 END) AS v FROM b GROUP BY {key})
  SELECT {key}, (CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END)::BIGINT AS simhash FROM u)"""


_MAST = r"(?:[A-Z][^\s\d.!?%:;,\"']*|(?:a|an|and|at|de|du|for|in|la|le|of|on|the)(?:\s|$)|[^\sA-Za-z\d.!?%:;,\"'][^\s\d.!?%:;,\"']*)"
_TRACK = "^((" + "|".join(TRACKING_NAMES) + ")|(" + "|".join(TRACKING_PREFIXES) + ").*)$"
CANON = f"""(SELECT id, CASE WHEN raw = '' THEN '' ELSE (CASE WHEN scheme IN ('http', '') THEN 'https' ELSE scheme END) || '://' || regexp_replace(host, '^www\\.', '')
    || CASE WHEN port <> '' AND port NOT IN ('80', '443') THEN ':' || port ELSE '' END
    || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END
    || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(list_sort(pairs), '&') ELSE '' END END AS canonical_url
  FROM (SELECT id, raw, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
      lower(regexp_extract(u, '^[^:]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, regexp_extract(u, '^[^:]*://(?:[^/?#@]*@)?[^/?#:]*:(\\d+)', 1) AS port,
      regexp_extract(u, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path,
      list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+') AND NOT regexp_matches(lower(split_part(p, '=', 1)), '{_TRACK}')) AS pairs
    FROM (SELECT id, raw, CASE WHEN contains(raw, '://') THEN raw ELSE 'https://' || ltrim(raw, '/') END AS u
      FROM (SELECT {{key}} AS id, replace(trim(regexp_replace(coalesce({{url}}, ''), '[\\s\\p{{Z}}\\p{{C}}]+', ' ', 'g')), '&amp;', '&') AS raw FROM {{source}}))))"""


def canon_sql(source: str, key: str, url: str) -> str:
    return CANON.replace("{source}", source).replace("{key}", key).replace("{url}", url)


ORACLE = {
    "tokens": f"SELECT id, len(t)::INT AS n_tokens, array_to_string(t, ' ') AS normalized FROM (SELECT id, {tok('title')} AS t FROM {A})",
    "text_hashes": f"SELECT id, sha256(array_to_string({tok('title')}, ' ')) AS title_hash, sha256(array_to_string({tok('coalesce(title, chr(32)) || chr(32) || coalesce(excerpt, chr(32))')}, ' ')) AS text_hash FROM {A}",
    "body_texts": f"SELECT id, length(b)::INT AS n_chars, CASE WHEN length({ws('b')}) <= 80 THEN {ws('b')} ELSE rtrim(substr({ws('b')}, 1, 79)) || '…' END AS short FROM (SELECT id, {BODY} AS b FROM {A})",
    "sentence_split": f"SELECT id, len(s)::INT AS n_sentences, coalesce(s[1], '') AS first_sentence FROM (SELECT id, list_filter(string_split(regexp_replace({ws('excerpt')}, '([.!?]) +([A-Z(\"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: x <> '') AS s FROM {A})",
    "html_text": f"SELECT doc_id, length(t)::INT AS n_chars_plain, len({tok('t')})::INT AS n_tokens FROM (SELECT doc_id, {ws('regexp_replace(coalesce(text, chr(32)), chr(60) || chr(91) || chr(94) || chr(62) || chr(93) || chr(43) || chr(62), chr(32), chr(103))')} AS t FROM documents)",
    "url_canonical": f"SELECT id, canonical_url FROM {canon_sql(A, 'id', 'url')}",
    "url_domain": f"""SELECT rec_id, CASE WHEN n >= 2 AND (n >= 3 AND (l2 IN ({quoted(DOUBLE_SUFFIXES)}) OR (l2 IN ({quoted(TENANT_HOSTS)}) AND l[-3] <> 'www'))) THEN l[-3] || '.' || l2
      WHEN n >= 2 AND l2 NOT IN ({quoted(DOUBLE_SUFFIXES)}) THEN l2 ELSE regexp_replace(h, '^www\\.', '') END AS url_domain
      FROM (SELECT rec_id, h, l, len(l) AS n, CASE WHEN len(l) >= 2 THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS l2 FROM (SELECT rec_id, h, string_split(h, '.') AS l FROM
      (SELECT rec_id, lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h FROM ai_models)))""",
    "lang_normalize": "SELECT CASE WHEN t = '' THEN 'unknown' ELSE t END AS language, count(*) AS docs FROM (SELECT split_part(replace(lower(trim(coalesce(lang, ''))), '_', '-'), '-', 1) AS t FROM documents) GROUP BY 1",
    "quantities": f"""SELECT DISTINCT id, CASE u WHEN '%' THEN 'percent' WHEN 'bn' THEN 'billion' WHEN 'gigawatt' THEN 'gigawatts' WHEN 'position' THEN 'jobs' WHEN 'positions' THEN 'jobs' WHEN 'people' THEN 'jobs' ELSE u END AS unit, v AS value
      FROM (SELECT id, regexp_extract(m, '([a-z%]+)$', 1) AS u, try_cast(replace(regexp_extract(m, '^([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', '') AS DOUBLE) AS v
      FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(title, '')), '{T.QUANTITY}')) AS m FROM {A})) WHERE v IS NOT NULL""",
    "claim_flags": f"SELECT id, regexp_matches(x, '{T.NEGATION}', 'i') AS negated, regexp_matches(x, '{T.HEDGE}', 'i') AS hedged, regexp_matches(x, '{T.DATE_HINT}', 'i') AS dated, len(list_filter({tok('x')}, lambda t: t IN ({quoted(T.ATTRIBUTION)}))) > 0 AS attributed FROM (SELECT id, coalesce(excerpt, '') AS x FROM {A})",
    "simhashes": f"SELECT a.id, coalesce(s.simhash, 0) AS simhash FROM {A} a LEFT JOIN {simhash_sql(A, 'id', 'title')} s ON a.id = s.id",
    "query_words": f"SELECT id, array_to_string(w, ' ') AS query FROM (SELECT id, list_filter({tok('title')}, lambda t: t NOT IN ({quoted(T.QUERY_STOP)}))[1:7] AS w FROM {A} WHERE id % 20 = 0) WHERE len(w) >= 4",
    "recency_weights": "SELECT doc_id, round(coalesce(pow(0.5::DOUBLE, greatest(0.0::DOUBLE, (1790000000.0::DOUBLE - epoch_us(published_at) // 1000000) / 3600.0::DOUBLE) / 48.0::DOUBLE), 1.0), 6) AS weight FROM documents",
}
