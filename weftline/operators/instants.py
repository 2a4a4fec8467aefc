"""Mixed timestamp forms and zones to UTC moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.instants import moment_parts, squeeze, wall_clock, wall_to_utc, zone_offset_minutes

MIN_MOMENT_US = 946_684_800_000_000  # 2000-01-01 UTC


def zone_names(spark: SparkSession) -> list[str]:
    """Names of IANA zones known to the JVM that runs the conversion (a fixed list of some 600)."""
    return sorted(x for x in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in x)


def is_zone(zone: Column, names: list[str]) -> Column:
    """Whether a text is one of the names: a search in one literal, which keeps the plan small."""
    return zone.contains("/") & (F.instr(F.lit(f",{','.join(names)},"), F.concat(F.lit(","), zone, F.lit(","))) > 0)


def let(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: projections don't collapse through a generator, so
    expressions built on the name don't repeat the value's own expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_walls(rows: DataFrame, text: str, date_order: Column, country: Column) -> DataFrame:
    """rows with _wall, _zone and _offset (minutes, null unless the text fixes one)."""
    df = let(rows, "_text", squeeze(F.col(text)))
    df = let(df, "_parts", moment_parts(F.col("_text")))
    df = let(df, "_clock", wall_clock(F.col("_parts"), date_order))
    df = df.withColumn("_wall", F.col("_clock.wall")).withColumn("_zone", F.col("_clock.zone"))
    return let(df, "_offset", zone_offset_minutes(F.col("_zone"), country)).drop("_text", "_parts", "_clock")


def estimate_zones(zoneless: DataFrame, source: str, wall: str, ingested_us: str, candidates: list[str], max_lag_hours: int = 24 * 60, lag_weight: float = 0.5, near_hours: float = 6.0) -> DataFrame:
    """For each source the zone whose offset history breaks fewest rules: a row can't have been
    ingested before the moment it tells, nor more than max_lag_hours after it. A broken rule costs 1, a kept one the lag's share of near_hours,
    one at most, times lag_weight, so that of zones which break no rule the nearest wins and a few wrong clocks (up to 8 percent) don't move a
    source to the next zone. Every row meets every candidate (there are some 600 zones at most); costs are added up before the shuffle, so a hot
    source is as cheap as any.

    Output: source, est_tz, violations, rows. Ties: the first zone by name. Rows without ingestion time or wall time
    don't vote; a source with none of them has no row; without candidates there are no rows."""
    known = zoneless.filter(F.col(wall).isNotNull() & F.col(ingested_us).isNotNull() & F.col(source).isNotNull())
    each = known.select(F.col(source), F.col(wall).alias("_w"), F.col(ingested_us).alias("_i"), F.explode(F.array(*[F.lit(z) for z in sorted(candidates)]).cast("array<string>")).alias("est_tz"))
    lag = (F.col("_i") - F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_w"), F.col("est_tz")))) / 3_600_000_000
    broken = (lag < 0) | (lag > max_lag_hours)
    cost = F.when(broken, 1.0).otherwise(lag_weight * F.least(lag / near_hours, F.lit(1.0)))
    told = each.groupBy(source, "est_tz").agg(F.sum(cost).alias("_cost"), F.count_if(broken).alias("violations"), F.count(F.lit(1)).alias("rows"))
    best = F.min(F.struct(F.round("_cost", 6).alias("c"), F.col("est_tz"), F.col("violations"), F.col("rows"))).alias("_b")
    return told.groupBy(source).agg(best).select(source, F.col("_b.est_tz").alias("est_tz"), F.col("_b.violations").alias("violations"), F.col("_b.rows").alias("rows"))


def _publishers(publishers: DataFrame) -> DataFrame:
    return publishers.select(F.col("source_domain").alias("_src"), F.col("sourcecountry").alias("_country"), F.col("tz").alias("_tz"), F.col("date_order").alias("_order")).dropDuplicates(["_src"])


def _joined(rows: DataFrame, source: str, pub: DataFrame, max_publishers: int) -> DataFrame:
    small = pub.limit(max_publishers + 1).count() <= max_publishers
    return rows.join(F.broadcast(pub) if small else pub, F.col(source) == F.col("_src"), "left")


def source_zones(rows: DataFrame, text: str, source: str, publishers: DataFrame, ingested_us: str, every: bool = False, max_publishers: int = 100_000) -> DataFrame:
    """(source, est_tz, violations, rows): the zones that estimate_zones finds, from the zoneless texts of rows, for the sources that publishers lacks or lists
    without zone; every: for all sources, which checks declared zones. Candidates are all zones that publishers declares, or, where it
    declares none, all that there are. Only rows of the sources in question are parsed."""
    names = zone_names(rows.sparkSession)
    pub = _publishers(publishers)
    declared = [r[0] for r in pub.filter(is_zone(F.col("_tz"), names)).select("_tz").distinct().collect()]  # at most as many as there are zones
    df = _joined(rows.select(F.col(text).alias("_said"), F.col(source).alias("_of"), F.col(ingested_us).alias("_in")), "_of", pub, max_publishers)
    if not every:
        df = df.filter(~F.coalesce(is_zone(F.col("_tz"), names), F.lit(False)))
    df = parse_walls(df, "_said", F.col("_order"), F.coalesce(F.col("_country"), F.lit(""))).filter(F.col("_zone") == "")
    return estimate_zones(df, "_of", "_wall", "_in", declared or names).withColumnRenamed("_of", source)


def to_moments(rows: DataFrame, text: str, source: str, publishers: DataFrame, ingested_us: str | None = None, max_publishers: int = 100_000, zones: DataFrame | None = None) -> DataFrame:
    """rows with utc_us, the moment that the text fixes, or null.

    publishers (source_domain, sourcecountry, tz, date_order) gives the zone in which text without
    a zone is read. A source that it lacks, or lists without zone, gets the zone of the table zones (source, est_tz), or the one that source_zones finds from
    ingestion times (column ingested_us); without either its zoneless rows give null.
    The table has one row per source and is broadcast only up to max_publishers rows; above that
    it is a shuffled join, with the same result. Null, empty, blank, junk, impossible, date-only and year-less text,
    moments before 2000 and wall times skipped or repeated by a clock change give null. Repeated
    rows are kept; other columns pass through unchanged, whatever their names (own helper columns
    start with an underscore)."""
    names = zone_names(rows.sparkSession)
    df = _joined(rows, source, _publishers(publishers), max_publishers)
    df = parse_walls(df, text, F.col("_order"), F.coalesce(F.col("_country"), F.lit("")))
    declared = F.when(is_zone(F.col("_tz"), names), F.col("_tz"))
    if zones is None and ingested_us is not None:
        zones = source_zones(rows, text, source, publishers, ingested_us, max_publishers=max_publishers)
    if zones is not None:
        df = df.join(zones.select(F.col(source).alias("_k"), F.col("est_tz").alias("_est")), F.col(source) == F.col("_k"), "left").drop("_k")
        declared = F.coalesce(declared, F.col("_est"))
    named = F.when(is_zone(F.col("_zone"), names), F.col("_zone"))
    at_zone = F.when(F.col("_zone") == "", declared).otherwise(named)
    df = let(df, "_at", at_zone)
    utc = F.when(F.col("_offset").isNotNull(), F.col("_wall") - F.col("_offset").cast("long") * 60_000_000).when(F.col("_at").isNotNull(), wall_to_utc(F.col("_wall"), F.col("_at")))
    df = let(df, "_utc", utc).withColumn("utc_us", F.when(F.col("_utc") >= MIN_MOMENT_US, F.col("_utc")))
    return df.drop("_src", "_country", "_tz", "_order", "_wall", "_zone", "_offset", "_est", "_at", "_utc")
