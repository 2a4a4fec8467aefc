"""Feeds and label files as DataFrames, and idempotent sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import strip_html
from weftline.functions.urls import extract_domain

ARTLIST = "articles array<struct<url:string,url_mobile:string,title:string,seendate:string,socialimage:string,domain:string,language:string,sourcecountry:string>>"
RAW = ["url", "title", "description", "excerpt", "source_domain", "language", "published_text", "topic", "source_adapter", "extraction_method"]
MAX_RECORDS = 250  # what one request to the list interface may return


def read_artlist(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """Article lists in JSON, one payload a file (topic from the name before the first dot unless given). Entries that aren't objects or lack
    an address are dropped; a payload that is no object gives nothing; the domain falls back to the address."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"), F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("_name"))
    # entries are read one by one, so that a broken one costs only itself
    entries = F.from_json(F.get_json_object("value", "$.articles"), "array<string>")
    rows = raw.select("_name", F.explode(entries).alias("e"))
    item = F.from_json("e", "url string, url_mobile string, title string, seendate string, socialimage string, domain string, language string, sourcecountry string")
    i = rows.select("_name", item.alias("i")).select("_name", "i.*").filter(F.trim(F.coalesce("url", F.lit(""))) != "")
    nothing = F.lit("")
    return i.select(
        "url", F.coalesce("title", nothing).alias("title"), nothing.alias("description"), nothing.alias("excerpt"), F.coalesce(F.nullif("domain", nothing), extract_domain(F.col("url"))).alias("source_domain"), F.coalesce(F.nullif("language", nothing), F.lit("unknown")).alias("language"),
        F.col("seendate").alias("published_text"), (F.lit(topic) if topic else F.col("_name")).alias("topic"), F.lit("gdelt").alias("source_adapter"), F.lit("metadata").alias("extraction_method"),
    )


def read_feed(spark: SparkSession, path: str, topic: str | None = None, row_tag: str = "item") -> DataFrame:
    """Items (RSS) or entries (Atom) of XML feeds: link, else id; published, else updated; markup stripped. Files that aren't XML give nothing."""
    schema = "title string, link string, guid string, id string, description string, summary string, content string, pubDate string, published string, updated string"
    x = spark.read.format("xml").option("rowTag", row_tag).option("mode", "DROPMALFORMED").schema(schema).load(path)
    url = F.coalesce(F.nullif(F.trim("link"), F.lit("")), F.nullif(F.trim("guid"), F.lit("")), F.trim("id"))
    body = F.coalesce("content", "description", "summary")
    return x.filter(F.coalesce(url, F.lit("")) != "").select(
        url.alias("url"), F.coalesce(F.trim("title"), F.lit("")).alias("title"), strip_html(F.coalesce("description", "summary")).alias("description"), strip_html(body).alias("excerpt"), extract_domain(url).alias("source_domain"), F.lit("unknown").alias("language"),
        F.coalesce("pubDate", "published", "updated").alias("published_text"), F.lit(topic).alias("topic"), F.lit("rss").alias("source_adapter"), F.lit("rss").alias("extraction_method"),
    )


def read_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """All *.gdelt.json and *.rss.xml files of a folder."""
    return read_artlist(spark, f"{folder}/*.gdelt.json").unionByName(read_feed(spark, f"{folder}/*.rss.xml"))


def read_story_labels(spark: SparkSession, path: str) -> DataFrame:
    """(canonical_url, story_label, topic) of a CSV with header; rows without address or label are skipped."""
    c = spark.read.csv(path, header=True)
    t = c.select(*[F.trim(x).alias(x) for x in ("canonical_url", "story_label", "topic")])
    return t.filter((F.coalesce("canonical_url", F.lit("")) != "") & (F.coalesce("story_label", F.lit("")) != ""))


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc_id, relevance) with positive relevance; unreadable rows are skipped."""
    c = spark.read.csv(path, header=True).select(F.trim("query").alias("query"), F.col("article_id").try_cast("long").alias("doc_id"), F.col("relevance").try_cast("double").alias("relevance"))
    return c.filter((F.coalesce("query", F.lit("")) != "") & F.col("doc_id").isNotNull() & (F.col("relevance") > 0))


def read_benchmark(spark: SparkSession, folder: str, max_documents: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, judgments) of a retrieval benchmark: corpus.jsonl, queries.jsonl, qrels.tsv with or without header. A limit on documents
    never drops a judged one."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl").withColumnRenamed("_id", "doc_id")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").withColumnRenamed("_id", "query_id")
    q = spark.read.csv(f"{folder}/qrels.tsv", sep="\t").toDF("query_id", "doc_id", "score").withColumn("relevance", F.col("score").try_cast("double")).filter("relevance > 0").drop("score")
    if max_documents is not None:
        judged = corpus.join(q.select("doc_id").distinct(), "doc_id", "left_semi")
        rest = corpus.join(q.select("doc_id").distinct(), "doc_id", "left_anti").orderBy("doc_id").limit(max(0, max_documents - judged.count()))
        corpus = judged.unionByName(rest)
    return corpus, queries, q


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, the one of the highest version for each key; new wins ties. Aggregated with partial maxima, so a hot key costs no more than others."""
    cols = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(F.col(version), F.col("_new"))).alias("_r")).select(*keys, "_r.*").select(*old.columns)


def enrich(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old plus the rows of new with other keys; on equal keys blanks of old are filled, nothing is overwritten. Applying it twice changes nothing."""
    one = new.dropDuplicates([key])
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    j = old.alias("o").join(one.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    pick = [F.coalesce(f"o.{key}", f"n.{key}").alias(key) if c == key else F.when(blank(f"o.{c}").isNotNull(), F.col(f"o.{c}")).otherwise(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).alias(c) for c in old.columns]
    return j.select(*pick)


def changed_keys(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to add, to delete) between two sets of rows."""
    return new.subtract(old), old.subtract(new)
