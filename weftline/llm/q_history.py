"""Problem 1: which new articles repeat the address or the headline of an article taken in before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.urls import canonicalize_url
from weftline.llm.headlines import Headlines
from weftline.llm.segments import TextHistory, canonical_rows
from weftline.operators.materialize import materialize, new_path
from weftline.sources.tables import table

BATCH_DAYS = 60  # one batch is what came in within so many days
MAX_MASTHEADS = 1_000_000
DAY_US = 86_400_000_000


def repeated_articles(articles: DataFrame, mastheads: list[str], batch_days: int = BATCH_DAYS, history: TextHistory | None = None) -> DataFrame:
    """(article_id) of each article that repeats one with an earlier retrieved_at, batch by batch.

    articles: id, title, url, retrieved_at; a repeated id counts once. Rows without retrieved_at are
    neither new nor earlier. Missing and placeholder headlines and missing addresses repeat nothing.
    Headlines and addresses enter one history, addresses as exact items. Within a batch and across batches the
    same segments are searched; a hot headline or address is one entry. A history that was opened from its
    folder goes on with what it holds."""
    spark = articles.sparkSession
    shared = spark.sparkContext.broadcast(mastheads)
    rows = articles.filter(F.col("id").isNotNull() & F.col("retrieved_at").isNotNull()).dropDuplicates(["id"])
    rows = rows.withColumn("_ts", F.unix_micros(F.col("retrieved_at").cast("timestamp")))
    address = canonicalize_url(F.col("url"))
    urls = rows.select(F.col("id").cast("long").alias("id"), F.col("_ts").alias("ts"), F.when(address != "", F.sha2(address, 256)).alias("text"), F.lit(True).alias("exact"))
    texts = canonical_rows(rows, "id", "_ts", "title", lambda: Headlines(shared.value).words).withColumn("exact", F.lit(False))
    items = texts.unionByName(urls).filter("text IS NOT NULL").withColumn("batch", F.floor(F.col("ts") / (batch_days * DAY_US)))
    path = new_path(spark, "incoming")
    items.repartition("batch", F.pmod("id", F.lit(8))).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    ready = spark.read.schema("id long, ts long, text string, exact boolean, batch long").parquet(path)
    history = history or TextHistory(spark)
    found = []
    for (batch,) in ready.select("batch").distinct().orderBy("batch").collect():
        new = ready.filter(F.col("batch") == batch)
        history.add(new)
        met = new.join(history.repeats(new), ["text", "exact"]).filter(F.col("ts") > F.col("first_ts"))
        found.append(materialize(met.select("id").distinct(), "repeats"))
    if not found:
        return rows.limit(0).select(F.col("id").cast("long").alias("article_id"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.col("id").alias("article_id"))


def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(article_id) of each article that repeats an earlier one."""
    names = [r[0] for r in table(spark, data_dir, "publishers").select("publisher").distinct().limit(MAX_MASTHEADS + 1).collect()]
    if len(names) > MAX_MASTHEADS:
        raise ValueError(f"more than {MAX_MASTHEADS} mastheads")
    return repeated_articles(table(spark, data_dir, "articles").select("id", "title", "url", "retrieved_at"), names)


QUERIES = {"p1_found": p1_found}
ORACLE: dict[str, str] = {}
