"""Duplicates hidden by formatting: canonical keys, hot keys counted in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64
HOT_SHARE = 1000


def plain_part(part: Column) -> Column:
    """Letters (lower case), digits and marks of a piece of an address: escapes decoded; white space, invisible
    characters and punctuation dropped. A piece with broken escapes keeps its own text."""
    decoded = part
    for _ in range(2):  # an escaped percent sign hides a second escape
        decoded = F.coalesce(F.try_url_decode(F.regexp_replace(decoded, r"\+", "%2B")), decoded)
    return F.lower(F.regexp_replace(decoded, r"[^\p{L}\p{N}\p{M}]+", ""))


def address_key(url: Column) -> Column:
    """The address without formatting: path and fragment as plain parts, parameters name=value as plain parts in sorted
    order (repeated ones kept). Null for null; '' for a text without letters and digits."""
    text = F.regexp_replace(url, r"(?i)&(amp|#38|#x26);", "&")
    path = F.split(text, r"[?#]", 2)[0]
    after = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    fragment = F.regexp_extract(text, r"(?s)#(.*)$", 1)

    def parameter(p: Column) -> Column:
        return F.concat(plain_part(F.substring_index(p, "=", 1)), F.lit("="), F.when(F.instr(p, "=") > 0, plain_part(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise(F.lit("")))

    params = F.array_sort(F.filter(F.transform(F.split(after, "&"), parameter), lambda p: p != "="))
    bare = plain_part(path)
    tail = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit(""))
    hash_part = plain_part(fragment)
    return F.when(url.isNull(), None).otherwise(F.concat(bare, tail, F.when(hash_part != "", F.concat(F.lit("#"), hash_part)).otherwise(F.lit(""))))


def collapse(rows: DataFrame, key: str, row_id: str, hot_share: int = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """(key, row_id, copies): one row per distinct key, with the smallest id and the number of rows.

    Level 0 counts every key exactly (partial counts before the shuffle). A key with more than
    1/hot_share of all rows is hot; there can be at most hot_share such keys, which bounds what is
    broadcast. Hot keys' rows are salted by id and aggregated in two levels; all others by one
    shuffle. Rows with a null key are left out; an empty table gives no rows; a null id never
    represents a group that has another id."""
    data = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(row_id).alias("_id"))
    counts = data.groupBy(F.xxhash64("_k").alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    total = data.count()
    hot = counts.filter(F.col("_n") > F.lit(max(total // hot_share, 100))).select("_h", F.lit(True).alias("_hot"))
    marked = data.withColumn("_h", F.xxhash64("_k")).join(F.broadcast(hot), "_h", "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_id"), F.lit(salts))).otherwise(F.lit(0))
    first = marked.groupBy("_k", "_hot", salt.alias("_salt")).agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    cold = first.filter(F.col("_hot").isNull()).select("_k", "_id", "_n")
    second = first.filter(F.col("_hot")).groupBy("_k").agg(F.min("_id").alias("_id"), F.sum("_n").alias("_n"))
    return cold.unionByName(second).select(F.col("_k").alias(key), F.col("_id").alias(row_id), F.col("_n").alias("copies"))
