"""Session settings that every job of this package expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "weftline", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow. On a cluster leave master and partitions unset: they
    then come from spark-submit, and AQE coalesces what is too small."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
