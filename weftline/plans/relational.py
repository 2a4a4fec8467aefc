"""Queries on stories, topics, splits, joins, sets; the relational read path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions import text as T
from weftline.functions.urls import canonicalize_url
from weftline.operators.ordering import as_of, chronological_split, global_row_number, interval_overlap
from weftline.plans.texts import A, articles, canon_sql, tok
from weftline.sources.tables import table


def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Topic, time, language and duplicate filters at once; all reach the scan."""
    a = table(spark, d, "articles").filter((F.col("topic") == "ai_models") & (F.col("retrieved_at") >= F.lit("2025-10-01T00:00:00Z").cast("timestamp")) & ~F.col("is_near_duplicate") & (F.lower("language") == "english"))
    return a.select("id", "source_domain").distinct()


def entity_filter(spark: SparkSession, d: str) -> DataFrame:
    """A phrase anywhere in title or excerpt."""
    b = F.lower(T.body_text(F.col("title"), F.col("excerpt")))
    return articles(spark, d, "title", "excerpt").filter(b.contains("solar farm")).select("id")


def all_terms_match(spark: SparkSession, d: str) -> DataFrame:
    t = T.token_set(T.body_text(F.col("title"), F.col("excerpt")))
    return articles(spark, d, "title", "excerpt").filter(F.forall(F.array(F.lit("approval"), F.lit("objections")), lambda q: F.array_contains(t, q))).select("id")


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Articles with the story that a label gives their address."""
    a = articles(spark, d, "url", "source_domain", "topic", "retrieved_at", "is_near_duplicate")
    u = canonicalize_url(F.col("url"))
    labels = table(spark, d, "fixture_story_labels").filter("canonical_url IS NOT NULL").groupBy(canonicalize_url(F.col("canonical_url")).alias("u")).agg(F.min_by("story_label", "label_id").alias("story_label"))
    return a.withColumn("u", u).join(labels, "u").drop("u", "url")


def story_members(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).select("id", "story_label")


def story_aggregates(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    dup = F.coalesce("is_near_duplicate", F.lit(False))
    return m.groupBy("story_label").agg(
        F.count(F.lit(1)).alias("articles"), F.countDistinct(F.when(~dup, F.col("source_domain"))).alias("domains"), F.count_if(dup).alias("duplicates"), F.unix_micros(F.min("retrieved_at")).alias("first_us"), F.unix_micros(F.max("retrieved_at")).alias("last_us")
    )


def story_domains(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d).filter(~F.coalesce("is_near_duplicate", F.lit(False)))
    return m.groupBy("story_label").agg(F.array_join(F.sort_array(F.collect_set("source_domain")), ",").alias("domains"))


def story_list(spark: SparkSession, d: str) -> DataFrame:
    """A page of stories: most domains first, then the latest."""
    s = story_aggregates(spark, d).filter(F.col("articles") >= 1)
    return s.orderBy(F.desc("domains"), F.desc_nulls_last("last_us"), F.desc("story_label")).offset(5).limit(20)


def first_reports(spark: SparkSession, d: str) -> DataFrame:
    """The earliest independent article of each story; a story of duplicates only has none."""
    m = _members(spark, d).filter(~F.coalesce("is_near_duplicate", F.lit(False)))
    return m.groupBy("story_label").agg(F.min_by("id", F.struct("retrieved_at", "id")).alias("first_id"))


def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    """Articles and documents by topic, zero where a topic has none."""
    a = articles(spark, d, "topic").groupBy("topic").agg(F.count(F.lit(1)).alias("n_articles"))
    o = table(spark, d, "documents").groupBy("topic").agg(F.count(F.lit(1)).alias("n_documents"))
    return a.join(o, "topic", "full").filter("topic IS NOT NULL").select("topic", F.coalesce("n_articles", F.lit(0)).alias("n_articles"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def global_counts(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "is_near_duplicate", "topic").agg(F.count(F.lit(1)).alias("articles"), F.count_if("is_near_duplicate").alias("duplicates"), F.countDistinct("topic").alias("topics"), F.max("id").alias("max_id"))


def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    """The eight most frequent content words of each topic."""
    w = articles(spark, d, "title", "topic").filter("topic IS NOT NULL").select("topic", F.explode(F.filter(T.tokens(F.col("title")), lambda t: ~t.isin(T.TITLE_STOP) & (F.length(t) > 3))).alias("word"))
    c = w.groupBy("topic", "word").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("n"), "word"))).filter("rank <= 8")


def chrono_split(spark: SparkSession, d: str) -> DataFrame:
    s = chronological_split(articles(spark, d, "retrieved_at"), "retrieved_at", "id")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.unix_micros(F.min("retrieved_at")).alias("first_us"), F.unix_micros(F.max("retrieved_at")).alias("last_us"))


def time_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Twelve equal closed-open slices of the events' span; the last ends at its end."""
    e = table(spark, d, "events").select("ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    span = e.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    n = F.least(F.floor((F.col("t") - F.col("lo")) * 12 / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), F.lit(11))
    return e.crossJoin(F.broadcast(span)).groupBy(n.alias("tile")).agg(F.count(F.lit(1)).alias("events"))


def label_pairs_band(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed pairs close to the threshold, the closest first."""
    p = table(spark, d, "story_pairs").select("article_a_id", "article_b_id", "score").filter(F.col("score").between(0.6, 0.7) & F.col("article_a_id").isNotNull() & F.col("article_b_id").isNotNull()).distinct()
    return p.orderBy(F.abs(F.col("score") - 0.65), "article_a_id", "article_b_id").limit(50)


def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no vector was stored for."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


def semi_orders(spark: SparkSession, d: str) -> DataFrame:
    late = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(late, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


def latest_by_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.max("vec_id").alias("latest"), F.count(F.lit(1)).alias("vectors"))


def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ai_models").select("domain", "language").distinct()


def source_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sources of articles that also have documents, those that don't, and all, by set operations."""
    a, o = table(spark, d, "articles").select(F.col("source_domain").alias("s")), table(spark, d, "documents").select(F.col("source").alias("s"))
    one = lambda df, what: df.select(F.lit(what).alias("what"), "s")
    return one(a.intersect(o), "both").unionByName(one(a.subtract(o), "articles_only")).unionByName(one(a.union(o).distinct(), "all")).groupBy("what").agg(F.count(F.lit(1)).alias("sources"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile(v, 0.5), 6).alias("p50"), F.round(F.percentile(v, 0.95), 6).alias("p95"), F.round(F.avg(v), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def corpus_description(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents")
    per = c.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    a = c.agg(F.count(F.lit(1)).alias("docs"), F.unix_micros(F.min("published_at")).alias("first_us"), F.unix_micros(F.max("published_at")).alias("last_us"))
    return a.crossJoin(F.broadcast(per.agg(F.count(F.lit(1)).alias("sources"), F.round(F.median("n"), 3).alias("median_size"), F.max("n").alias("max_size"))))


def merged_articles(spark: SparkSession, d: str) -> DataFrame:
    """Idempotent enrichment: one row per address, blanks of the first row filled from later ones."""
    a = articles(spark, d, "url", "title", "excerpt", "topic").withColumn("u", canonicalize_url(F.col("url"))).filter("u <> ''")
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("id"))).alias(c)
    return a.groupBy("u").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), first("title"), first("topic")).filter("rows > 1").select("id", "rows", "title", "topic")


def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Upsert of events by user: the last row of each user and type stays."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))


def story_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of topics' weekly windows: articles of one source whose 72-hour windows overlap those of events, by bucketed range join."""
    day = 86_400_000_000
    o = table(spark, d, "orders").filter(F.col("o_custkey") % 50 == 0).select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("s")).withColumn("e", F.col("s") + 3 * day)
    w = table(spark, d, "lineitem").filter(F.col("l_partkey") % 500 == 0).select("l_orderkey", "l_linenumber", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("lo")).withColumn("hi", F.col("lo") + day)
    return interval_overlap(o, w, "s", "e", "lo", "hi", 4 * day).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("overlaps"))


def events_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's last view before it."""
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("vts"), "event_id")
    return as_of(left, right, "user_id", "ts", "vts", ["event_id"]).select("event_id", F.col("right_event_id").alias("view_id"))


def label_ids(spark: SparkSession, d: str) -> DataFrame:
    """Stories numbered by first appearance."""
    f = table(spark, d, "fixture_story_labels").filter("story_label IS NOT NULL").groupBy("story_label").agg(F.min("label_id").alias("first_label"))
    return global_row_number(f, "first_label", "story_label").select("story_label", (F.col("rn") - 1).alias("story_id"))


QUERIES = {
    f.__name__: f
    for f in (search_filtered, entity_filter, all_terms_match, story_members, story_aggregates, story_domains, story_list, first_reports, topic_counts, global_counts, keyword_topk, chrono_split, time_tiles, label_pairs_band, missing_embeddings, semi_orders, latest_by_label, distinct_sources, source_sets, latency_percentiles, corpus_description, merged_articles, latest_wins, story_overlap, events_as_of, label_ids)
}

_M = f"""m AS (SELECT a.*, l.story_label FROM {A} a JOIN {canon_sql(A, 'id', 'url')} c ON a.id = c.id JOIN
  (SELECT u, arg_min(story_label, k) AS story_label FROM (SELECT x.id AS k, x.canonical_url AS u, y.story_label FROM {canon_sql('(SELECT * FROM fixture_story_labels WHERE canonical_url IS NOT NULL)', 'label_id', 'canonical_url')} x JOIN fixture_story_labels y ON y.label_id = x.id) GROUP BY u) l ON l.u = c.canonical_url)"""
_AGG = "SELECT story_label, count(*) AS articles, count(DISTINCT CASE WHEN NOT coalesce(is_near_duplicate, false) THEN source_domain END) AS domains, count(*) FILTER (WHERE coalesce(is_near_duplicate, false)) AS duplicates, epoch_us(min(retrieved_at)) AS first_us, epoch_us(max(retrieved_at)) AS last_us FROM m GROUP BY story_label"
_B = "lower(trim((CASE WHEN coalesce(title, '') = '' OR regexp_matches(title, '[.!?]$') THEN coalesce(title, '') ELSE title || '.' END) || ' ' || coalesce(excerpt, '')))"
_DAY = 86_400_000_000
ORACLE = {
    "search_filtered": "SELECT DISTINCT id, source_domain FROM articles WHERE topic = 'ai_models' AND retrieved_at >= TIMESTAMPTZ '2025-10-01 00:00:00+00' AND NOT is_near_duplicate AND lower(language) = 'english'",
    "entity_filter": f"SELECT id FROM {A} WHERE contains({_B}, 'solar farm')",
    "all_terms_match": f"SELECT id FROM {A} WHERE list_contains({tok(_B)}, 'approval') AND list_contains({tok(_B)}, 'objections')",
    "story_members": f"WITH {_M} SELECT id, story_label FROM m",
    "story_aggregates": f"WITH {_M} {_AGG}",
    "story_domains": f"WITH {_M} SELECT story_label, string_agg(DISTINCT source_domain, ',' ORDER BY source_domain) AS domains FROM m WHERE NOT coalesce(is_near_duplicate, false) GROUP BY story_label",
    "story_list": f"WITH {_M} SELECT * FROM ({_AGG}) ORDER BY domains DESC, last_us DESC NULLS LAST, story_label DESC LIMIT 20 OFFSET 5",
    "first_reports": f"WITH {_M} SELECT story_label, arg_min(id, (retrieved_at, id)) AS first_id FROM m WHERE NOT coalesce(is_near_duplicate, false) GROUP BY story_label",
    "topic_counts": f"SELECT topic, coalesce(x.n, 0) AS n_articles, coalesce(y.n, 0) AS n_documents FROM (SELECT topic, count(*) AS n FROM {A} WHERE topic IS NOT NULL GROUP BY topic) x FULL JOIN (SELECT topic, count(*) AS n FROM documents WHERE topic IS NOT NULL GROUP BY topic) y USING (topic)",
    "global_counts": f"SELECT count(*) AS articles, count(*) FILTER (WHERE is_near_duplicate) AS duplicates, count(DISTINCT topic) AS topics, max(id) AS max_id FROM {A}",
    "keyword_topk": f"SELECT topic, word, count(*) AS n, (row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, word))::INT AS rank FROM (SELECT topic, unnest({tok('title')}) AS word FROM {A} WHERE topic IS NOT NULL) WHERE length(word) > 3 AND word NOT IN ({', '.join(chr(39) + w + chr(39) for w in T.TITLE_STOP)}) GROUP BY topic, word QUALIFY rank <= 8",
    "chrono_split": f"SELECT split, count(*) AS rows, epoch_us(min(retrieved_at)) AS first_us, epoch_us(max(retrieved_at)) AS last_us FROM (SELECT retrieved_at, CASE WHEN r <= greatest(1, floor(n * 0.6)) THEN 'fit' WHEN r <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM (SELECT retrieved_at, row_number() OVER (ORDER BY retrieved_at NULLS FIRST, id) AS r, count(*) OVER () AS n FROM {A})) GROUP BY split",
    "time_tiles": "SELECT least(((t - lo) * 12) // greatest(hi - lo, 1), 11)::BIGINT AS tile, count(*) AS events FROM (SELECT epoch_us(ts) AS t FROM events), (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events) GROUP BY 1",
    "label_pairs_band": "SELECT * FROM (SELECT DISTINCT article_a_id, article_b_id, score FROM story_pairs WHERE score BETWEEN 0.6 AND 0.7 AND article_a_id IS NOT NULL AND article_b_id IS NOT NULL) ORDER BY abs(score - 0.65::DOUBLE), article_a_id, article_b_id LIMIT 50",
    "missing_embeddings": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "semi_orders": "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY o_orderpriority",
    "latest_by_label": "SELECT label, max(vec_id) AS latest, count(*) AS vectors FROM embeddings GROUP BY label",
    "distinct_sources": "SELECT DISTINCT domain, language FROM ai_models",
    "source_sets": "WITH a AS (SELECT DISTINCT source_domain AS s FROM articles), o AS (SELECT DISTINCT source AS s FROM documents) SELECT what, count(*) AS sources FROM (SELECT 'both' AS what, s FROM (SELECT s FROM a INTERSECT SELECT s FROM o) UNION ALL SELECT 'articles_only', s FROM (SELECT s FROM a EXCEPT SELECT s FROM o) UNION ALL SELECT 'all', s FROM (SELECT s FROM a UNION SELECT s FROM o)) GROUP BY what",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type",
    "corpus_description": "SELECT (SELECT count(*) FROM documents) AS docs, (SELECT epoch_us(min(published_at)) FROM documents) AS first_us, (SELECT epoch_us(max(published_at)) FROM documents) AS last_us, count(*) AS sources, round(median(n), 3) AS median_size, max(n)::BIGINT AS max_size FROM (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source)",
    "merged_articles": f"SELECT id, rows, title, topic FROM (SELECT min(a.id) AS id, count(*) AS rows, arg_min(title, CASE WHEN coalesce(title, '') <> '' THEN a.id END) AS title, arg_min(topic, CASE WHEN coalesce(topic, '') <> '' THEN a.id END) AS topic FROM {A} a JOIN {canon_sql(A, 'id', 'url')} c ON a.id = c.id WHERE canonical_url <> '' GROUP BY canonical_url) WHERE rows > 1",
    "latest_wins": "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id, event_type",
    "story_overlap": f"WITH o AS (SELECT o_orderkey, epoch_us(o_orderdate) AS s FROM orders WHERE o_custkey % 50 = 0), w AS (SELECT epoch_us(l_shipdate) AS lo FROM lineitem WHERE l_partkey % 500 = 0) SELECT o_orderkey, count(*) AS overlaps FROM o JOIN w ON s <= lo + {_DAY} AND lo <= s + {3 * _DAY} GROUP BY o_orderkey",
    "events_as_of": "SELECT l.event_id, r.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts",
    "label_ids": "SELECT story_label, row_number() OVER (ORDER BY f, story_label) - 1 AS story_id FROM (SELECT story_label, min(label_id) AS f FROM fixture_story_labels WHERE story_label IS NOT NULL GROUP BY story_label)",
}
