"""Problem 4: one record per address, however it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.formatting import address_key, collapse
from weftline.operators.materialize import materialize
from weftline.sources.tables import table


def address_records(spark: SparkSession, data_dir: str) -> DataFrame:
    """(source_table, row_id, key hash) of every row with an address. In ai_models both addresses count, in either order."""
    labels = table(spark, data_dir, "fixture_story_labels").select(F.lit("fixture_story_labels").alias("source_table"), F.col("label_id").alias("row_id"), address_key(F.col("canonical_url")).alias("_a"), F.lit("").alias("_b"))
    models = table(spark, data_dir, "ai_models").select(F.lit("ai_models").alias("source_table"), F.col("rec_id").alias("row_id"), address_key(F.col("url")).alias("_a"), F.coalesce(address_key(F.col("url_mobile")), F.lit("")).alias("_b"))
    both = labels.unionByName(models).filter(F.coalesce(F.col("_a"), F.lit("")) != "")
    joined = F.concat_ws("\n", "source_table", F.array_join(F.array_sort(F.array("_a", "_b")), "\n"))
    # 256 bits stand for the address from here on: shuffles carry 32 bytes instead of two texts
    return both.select("source_table", "row_id", F.unhex(F.sha2(joined, 256)).alias("key"))


def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(source_table, row_id, copies) of every record with two or more copies."""
    keys = materialize(address_records(spark, data_dir), "addresses")
    tagged = keys.select(F.concat(F.encode(F.substring("source_table", 1, 1), "utf-8"), F.col("key")).alias("key"), "row_id")
    found = collapse(tagged, "key", "row_id").filter(F.col("copies") > 1)
    name = F.when(F.substring(F.col("key"), 1, 1) == F.encode(F.lit("a"), "utf-8"), F.lit("ai_models")).otherwise(F.lit("fixture_story_labels"))
    return found.select(name.alias("source_table"), "row_id", "copies")


QUERIES = {"p4_found": p4_found}


def _plain(x: str) -> str:
    return f"lower(regexp_replace(url_decode(replace({x}, '+', '%2B')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g'))"


def _key(u: str) -> str:
    t = f"regexp_replace({u}, '&(amp|#38|#x26);', '&', 'gi')"
    p = f"list_sort(list_filter(list_transform(string_split(regexp_extract({t}, '(?s)\\?([^#]*)', 1), '&'), lambda p: {_plain("string_split(p, chr(61))[1]")} || '=' || CASE WHEN instr(p, '=') > 0 THEN {_plain('substr(p, instr(p, chr(61)) + 1)')} ELSE '' END), lambda p: p <> '='))"
    f = _plain(f"regexp_extract({t}, '(?s)#(.*)$', 1)")
    head = _plain(f"regexp_extract({t}, '(?s)^[^?#]*', 0)")
    return f"({head} || CASE WHEN len({p}) > 0 THEN '?' || array_to_string({p}, '&') ELSE '' END || CASE WHEN {f} <> '' THEN '#' || {f} ELSE '' END)"


ORACLE = {
    "p4_found": f"""WITH r AS (
  SELECT 'fixture_story_labels' AS source_table, label_id AS row_id, {_key("canonical_url")} AS a, '' AS b FROM fixture_story_labels
  UNION ALL SELECT 'ai_models', rec_id, {_key("url")}, coalesce({_key("url_mobile")}, '') FROM ai_models),
g AS (SELECT source_table, least(a, b) AS x, greatest(a, b) AS y, min(row_id) AS row_id, count(*) AS copies FROM r WHERE coalesce(a, '') <> '' GROUP BY ALL)
SELECT source_table, row_id, copies FROM g WHERE copies > 1""",
}
