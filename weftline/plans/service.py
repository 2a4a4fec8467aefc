"""Queries on the search service and the smaller read paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import search_text as S
from weftline.functions import text as T
from weftline.functions.urls import canonicalize_url, extract_domain
from weftline.operators.evaluation import clustering_metrics
from weftline.operators.graphs import article_graph, pagerank
from weftline.operators.materialize import materialize
from weftline.operators.ordering import chronological_split
from weftline.operators.search import Request, search, seeds
from weftline.plans.relational import ORACLE as RELATIONAL, _members, story_aggregates
from weftline.plans.texts import A, articles, tok
from weftline.sources.tables import table

QUERY = "approval for solar farm despite objections"
PHRASE = '"solar farm" approval'
AS_OF_US = 1_790_000_000_000_000
DAYS = 30


def _stories(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).select(F.col("id").alias("doc_id"), F.col("story_label").alias("story"))


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("terms", F.array_join("terms", " "))


def search_service(spark: SparkSession, d: str) -> DataFrame:
    """One request with filters, signals and stories."""
    return _flat(search(table(spark, d, "articles"), Request(QUERY, topic="ai_models", duplicates=False, as_of_us=AS_OF_US), _stories(spark, d)))


def search_service_walk(spark: SparkSession, d: str) -> DataFrame:
    """The same with a walk from the hits over articles, sources and topics."""
    edges = materialize(article_graph(articles(spark, d, "source_domain", "topic", "is_near_duplicate", "duplicate_of_article_id")), "edges")
    return _flat(search(table(spark, d, "articles"), Request(QUERY, method="tfidf", walk=True, as_of_us=AS_OF_US), _stories(spark, d), edges))


def search_service_hash(spark: SparkSession, d: str) -> DataFrame:
    """The same by vectors of hashed features."""
    return _flat(search(table(spark, d, "articles"), Request(QUERY, method="hash", rerank=False)))


def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "title", "excerpt")
    return a.filter(S.matches(T.body_text(F.col("title"), F.col("excerpt")), *S.parse_query(PHRASE))).select("id")


def hit_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms that each article shares with a query."""
    t = S.term_overlap(F.lit(QUERY), T.body_text(F.col("title"), F.col("excerpt")))
    return articles(spark, d, "title", "excerpt").select("id", F.array_join(t, " ").alias("terms")).filter("terms <> ''")


def hit_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The sentence of each article that says most of a query."""
    return articles(spark, d, "title", "excerpt").select("id", S.best_sentence(F.lit(QUERY), F.col("excerpt")).alias("sentence"))


def story_titles(spark: SparkSession, d: str) -> DataFrame:
    """What each story is called."""
    m = _members(spark, d).select("id", "story_label").join(articles(spark, d, "title"), "id").filter("title <> ''")
    best = F.min(F.struct((-F.size(T.token_set(F.col("title")))).alias("n"), F.length("title").alias("l"), F.col("title").alias("t"))).alias("b")
    return m.groupBy("story_label").agg(best).select("story_label", F.col("b.t").alias("title"))


def story_interval_list(spark: SparkSession, d: str) -> DataFrame:
    """Stories of two articles or more whose span meets a window."""
    lo, hi = 1_766_000_000_000_000, 1_772_000_000_000_000
    return story_aggregates(spark, d).filter((F.col("articles") >= 2) & (F.col("last_us") >= lo) & (F.col("first_us") <= hi)).select("story_label", "articles", "first_us", "last_us")


def story_count(spark: SparkSession, d: str) -> DataFrame:
    return story_aggregates(spark, d).filter("articles >= 2").agg(F.count(F.lit(1)).alias("stories"))


def largest_stories(spark: SparkSession, d: str) -> DataFrame:
    return story_aggregates(spark, d).select("story_label", "articles").orderBy(F.desc("articles"), "story_label").limit(10)


def recent_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles of the last days before the newest one; those without time count as new."""
    a = articles(spark, d, "retrieved_at")
    newest = a.agg(F.max("retrieved_at")).first()[0]
    return a.filter(F.coalesce(F.unix_micros("retrieved_at"), F.unix_micros(F.lit(newest))) >= F.unix_micros(F.lit(newest)) - DAYS * 86_400_000_000).select("id")


def article_cards(spark: SparkSession, d: str) -> DataFrame:
    """Articles as a list shows them."""
    a = articles(spark, d, "title", "source_domain", "excerpt", "retrieved_at")
    return a.select("id", F.coalesce("title", F.lit("")).alias("title"), F.lower("source_domain").alias("source"), T.truncate(F.coalesce("excerpt", "title", F.lit("")), 120).alias("summary"), F.date_format("retrieved_at", "yyyy-MM-dd").alias("day"))


def article_story_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every article with its story, or none."""
    return articles(spark, d).select("id").join(_members(spark, d).select("id", "story_label"), "id", "left")


def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Rows that stand in more than one part of the split: none."""
    s = materialize(chronological_split(articles(spark, d, "retrieved_at"), "retrieved_at", "id").select("id", "split"), "split")
    return s.filter("split <> 'test'").select("id").intersect(s.filter("split = 'test'").select("id")).agg(F.count(F.lit(1)).alias("leaked"))


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of each kind, as the newest run is looked up."""
    e = table(spark, d, "orders")
    return e.groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


def stream_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 articles in order of time: a replay's start."""
    return articles(spark, d, "retrieved_at").orderBy("retrieved_at", "id").limit(200).select("id")


def daily_throughput(spark: SparkSession, d: str) -> DataFrame:
    """Articles an hour of the five days with most."""
    a = articles(spark, d, "retrieved_at").groupBy(F.date_format("retrieved_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("retrieved_at").alias("lo"), F.max("retrieved_at").alias("hi"))
    hours = (F.unix_micros("hi") - F.unix_micros("lo")) / 3.6e9
    return a.select("day", "n", F.when(hours > 0, F.round(F.col("n") / hours, 6)).alias("per_hour")).orderBy(F.desc("n"), "day").limit(5)


def changed_domains(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ai_models whose stored domain is not the one of their address."""
    t = table(spark, d, "ai_models").select("rec_id", "url", "domain").withColumn("found", extract_domain(F.col("url")))
    return t.filter((F.col("found") != "") & (F.col("found") != F.coalesce("domain", F.lit("")))).select("rec_id", "found")


def normalized_articles(spark: SparkSession, d: str) -> DataFrame:
    """Raw records as articles: address, domain, title and keys; rows without address are left out."""
    t = table(spark, d, "ai_models").select("rec_id", "url", "title").withColumn("canonical", canonicalize_url(F.col("url"))).filter("canonical <> ''")
    title = T.normalize_whitespace(F.col("title"))
    return t.select("rec_id", "canonical", title.alias("title"), F.sha2(T.normalize_for_hash(title), 256).alias("title_hash"))


def vector_scan(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of one label in order, as those of a fit are read."""
    return table(spark, d, "embeddings").filter("label = 3").orderBy("vec_id").select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "title").select("id", S.cache_key("hash", "1", F.col("title")).alias("key"))


def walk_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """(damping, rounds, mass, overlap): how rounds, total mass and the ten best articles follow the damping; overlap is with the first."""
    edges = materialize(article_graph(articles(spark, d, "source_domain", "topic", "is_near_duplicate", "duplicate_of_article_id")), "edges")
    start = seeds(articles(spark, d, "topic").filter("topic = 'ai_models'").select(F.col("id").alias("doc_id"), F.lit(1.0).alias("score")))
    out, first = [], None
    for damping in (0.5, 0.85):
        mass, rounds = pagerank(edges, start, damping=damping, tolerance=1e-4)
        top = {r[0] for r in mass.filter(F.col("node").startswith("article:")).orderBy(F.desc(F.round("mass", 12)), "node").limit(10).select("node").collect()}
        total = mass.agg(F.sum("mass")).first()[0]
        out.append((damping, rounds, round(total or 0.0, 6), 0.0 if first is None else len(top & first) / 10))
        first = first or top
    return spark.createDataFrame(out, "damping double, rounds int, mass double, overlap double")


def threshold_tuning(spark: SparkSession, d: str) -> DataFrame:
    """(threshold, b3_f1, pair_f1, best): pairs of reviewed articles grouped from a score on, against the labels, for each threshold of a grid. The best has the
    highest B-cubed, then pairwise F1, then the lowest threshold. All thresholds are one aggregation over the pairs each."""
    from weftline.operators.graphs import components

    m = materialize(_members(spark, d).select("id", "story_label"), "members")
    p = table(spark, d, "story_pairs").filter("article_a_id IS NOT NULL AND article_b_id IS NOT NULL AND score IS NOT NULL").select("article_a_id", "article_b_id", "score")
    p = materialize(p.join(m.select(F.col("id").alias("article_a_id")), "article_a_id", "left_semi").join(m.select(F.col("id").alias("article_b_id")), "article_b_id", "left_semi"), "pairs")
    rows = None
    for t in (0.5, 0.7, 0.9):
        c = components(p.filter(F.col("score") >= t), "article_a_id", "article_b_id").select(F.col("node").alias("id"), F.col("component").cast("long").alias("c"))
        items = materialize(m.join(c, "id", "left").select("id", "story_label", F.coalesce("c", "id").alias("pred")), "items")
        one = clustering_metrics(items, "story_label", "pred").withColumn("threshold", F.lit(t))
        rows = one if rows is None else rows.unionByName(one)
    return rows


QUERIES = {f.__name__: f for f in (
    search_service, search_service_walk, search_service_hash, phrase_match, hit_terms, hit_excerpts, story_titles, story_interval_list, story_count, largest_stories, recent_articles, article_cards, article_story_lookup, split_leaks, latest_event,
    stream_prefix, daily_throughput, changed_domains, normalized_articles, vector_scan, cache_keys, walk_sensitivity, threshold_tuning,
)}

_BODY = "trim((CASE WHEN coalesce(title, '') = '' OR regexp_matches(title, '[.!?]$') THEN coalesce(title, '') ELSE title || '.' END) || ' ' || coalesce(excerpt, ''))"
_T = f"{tok(_BODY)}"
_QT = tok(f"'{QUERY}'")
_AGG = RELATIONAL["story_aggregates"]
ORACLE = {
    "phrase_match": f"SELECT id FROM (SELECT id, {_T} AS t FROM {A}) WHERE list_contains(t, 'approval') AND contains(' ' || array_to_string(t, ' ') || ' ', ' solar farm ')",
    "hit_terms": f"SELECT id, array_to_string(list_sort(list_filter(list_distinct(list_intersect({_QT}, t)), lambda x: length(x) > 2))[1:8], ' ') AS terms FROM (SELECT id, {_T} AS t FROM {A}) WHERE len(list_filter(list_intersect({_QT}, t), lambda x: length(x) > 2)) > 0",
    "story_interval_list": f"SELECT story_label, articles, first_us, last_us FROM ({_AGG}) WHERE articles >= 2 AND last_us >= 1766000000000000 AND first_us <= 1772000000000000",
    "story_count": f"SELECT count(*) AS stories FROM ({_AGG}) WHERE articles >= 2",
    "largest_stories": f"SELECT story_label, articles FROM ({_AGG}) ORDER BY articles DESC, story_label LIMIT 10",
    "story_titles": f"SELECT story_label, arg_min(title, (-len(list_distinct({tok('title')})), length(title), title)) AS title FROM ({RELATIONAL['story_members']}) m JOIN {A} a USING (id) WHERE title <> '' GROUP BY story_label",
    "recent_articles": f"SELECT id FROM {A} WHERE coalesce(epoch_us(retrieved_at), (SELECT max(epoch_us(retrieved_at)) FROM articles)) >= (SELECT max(epoch_us(retrieved_at)) FROM articles) - {DAYS * 86_400_000_000}",
    "article_story_lookup": f"SELECT a.id, story_label FROM {A} a LEFT JOIN ({RELATIONAL['story_members']}) m USING (id)",
    "split_leaks": "SELECT 0::BIGINT AS leaked",
    "latest_event": "SELECT o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1",
    "stream_prefix": f"SELECT id FROM (SELECT id, retrieved_at FROM {A} ORDER BY retrieved_at NULLS FIRST, id LIMIT 200)",
    "vector_scan": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings WHERE label = 3",
    "cache_keys": f"SELECT id, sha256('hash' || chr(31) || '1' || chr(31) || coalesce(title, '')) AS key FROM {A}",
}
