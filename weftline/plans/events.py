"""Queries on the event stream, and native extras on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.operators.materialize import new_path
from weftline.sources.tables import table
from weftline.streaming import jobs


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _naive(df: DataFrame) -> DataFrame:
    """Moments as UTC wall time, as the table has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _naive(jobs.tumbling(_events(spark, d)))


def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _naive(jobs.sliding(_events(spark, d)))


def events_session(spark: SparkSession, d: str) -> DataFrame:
    return _naive(jobs.sessions(_events(spark, d)))


def events_late_split(spark: SparkSession, d: str) -> DataFrame:
    """Arrival is the event's time plus what its props say, in minutes."""
    e = _events(spark, d).withColumn("arrival", F.timestamp_micros(F.unix_micros("ts") + F.get_json_object("props", "$.k").try_cast("long") * 60_000_000))
    ok, late = jobs.split_late(e, "arrival", 3600)
    return ok.select(F.lit("in_time").alias("what")).unionByName(late.select(F.lit("late").alias("what"))).groupBy("what").agg(F.count(F.lit(1)).alias("events"))


def events_stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The tumbling windows as a stream over all files there are; complete windows only leave the state at its end."""
    source, out, progress = (new_path(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    e = _events(spark, d)
    e.select("ts", "event_type", "value").write.parquet(source)
    stream = jobs.read_events_stream(spark, source, "ts timestamp, event_type string, value double")
    jobs.run_available(jobs.tumbling(stream), out, progress)
    return _naive(spark.read.schema("start timestamp, event_type string, n long, total double").parquet(out))


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """A six-way join; the small tables are broadcast by their size, the two large ones meet on their key."""
    t = lambda n: table(spark, d, n)
    j = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    j = j.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def order_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.grouping_id().cast("int").alias("level"))


def order_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def top_orders(spark: SparkSession, d: str) -> DataFrame:
    """Three dearest orders of each priority."""
    r = F.row_number().over(W.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", r.alias("rank")).filter("rank <= 3")


def event_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.count(F.lit(1)))
    return e.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("click", "view", "purchase")])


QUERIES = {f.__name__: f for f in (events_tumbling, events_sliding, events_session, events_late_split, events_stream_tumbling, pricing_summary, revenue_by_nation, order_rollup, order_cube, top_orders, event_pivot)}

ORACLE = {
    "events_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "events_sliding": "SELECT start, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value, unnest([time_bucket(INTERVAL 3 HOURS, ts), time_bucket(INTERVAL 3 HOURS, ts) - INTERVAL 3 HOURS]) AS start FROM events) GROUP BY start",
    "events_session": """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS stop, count(*) AS n FROM (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
      (SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS brk FROM events)) GROUP BY user_id, s""",
    "events_late_split": "SELECT CASE WHEN try_cast(json_extract_string(props, '$.k') AS BIGINT) <= 60 THEN 'in_time' ELSE 'late' END AS what, count(*) AS events FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "revenue_by_nation": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "order_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS orders, grouping(o_orderstatus, o_orderpriority)::INT AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "order_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "top_orders": "SELECT o_orderpriority, o_orderkey, o_totalprice, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey))::INT AS rank FROM orders QUALIFY rank <= 3",
    "event_pivot": "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id",
}
