"""Consolidating pairwise matches into groups: hierarchical merging of spanning forests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.materialize import drop_path, materialize, new_path

EDGES_PER_TASK = 1_000_000
BROADCAST_ROWS = 200_000


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the pairs; (node, root) for every node, the root being the smallest id of
    its tree. Ids are made dense first, so memory follows the distinct nodes of this block."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(ids)))
    n = len(a)
    for u, v in zip(flat[:n].tolist(), flat[n:].tolist()):
        while parent[u] != u:
            parent[u] = parent[parent[u]]
            u = parent[u]
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        if u < v:
            parent[v] = u
        elif v < u:
            parent[u] = v
    root = np.empty(len(ids), dtype=np.int64)
    for i, p in enumerate(parent):  # a parent is never above its child, so roots are final
        root[i] = i if p == i else root[p]
    return ids, ids[root]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's pairs are taken in Arrow blocks: each block's forest replaces its pairs before
    the next is read, so a task holds one forest and one block at a time."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])
    node, root = np.empty(0, np.int64), np.empty(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= EDGES_PER_TASK:
            node, root = local_forest(*(np.concatenate(x) for x in zip((node, root), *held)))
            held, size = [], 0
    if held:
        node, root = local_forest(*(np.concatenate(x) for x in zip((node, root), *held)))
    for i in range(0, len(node), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 100_000]), pa.array(root[i : i + 100_000])], schema=schema)


def contracted(ties: DataFrame) -> DataFrame:
    """(node, root) of every end of the ties (u, v): each end hooks to its least neighbour if that is smaller, and pointers are doubled until all end in roots, so
    a chain of any length is one tree after log2(length) joins. An end that hooks to nothing has a tree with a smaller root next to it
    afterwards, so two contractions leave at most half of the ends: rounds grow with the logarithm of the ends."""
    ends = ties.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(ties.select(F.col("v").alias("node"), F.col("u").alias("other")))
    p = materialize(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")), "hooks")
    while True:
        up = p.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        q = materialize(p.join(up, "root").select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved")), "hooks")
        p = q.select("node", "root")
        if q.filter("moved").isEmpty():
            return p


def connect(pairs: DataFrame, a: str, b: str, edges_per_task: int = EDGES_PER_TASK, told: dict | None = None) -> DataFrame:
    """(node bigint, root bigint) for every node that has a pair with another node; root is the
    smallest node of all that it reaches, directly or through others.

    Each round spreads the pairs over bounded partitions (by range of the pair, so a node with a
    third of all pairs is split as well), finds every partition's spanning forest by union-find,
    and keeps only the forest. A node met in several partitions has several roots there; those
    roots are tied to the smallest, and the forests are merged along the ties (contracted). What ties remain
    between merged forests are the pairs of the next round, whose nodes are roots only; there are
    at most half as many after two rounds. When the pairs fit in one bounded partition, that round ends the job. Rounds write
    their map of node to root to the shared folder; afterwards the maps are applied one after the other.

    Pairs with a null end, loops and repeated or turned pairs add nothing; an empty table gives an
    empty result. Other columns are ignored. told["rounds"], if asked for, is the number of rounds."""
    spark = pairs.sparkSession
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = pairs.select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).filter(x.isNotNull() & y.isNotNull() & (x != y))
    maps: list[DataFrame] = []
    path = new_path(spark, "edges")
    edges.write.parquet(path)
    edges = spark.read.parquet(path)
    n = edges.count()
    rounds = 0
    while True:
        rounds += 1
        parts = max(1, -(-n // edges_per_task))
        spread = edges.coalesce(1) if parts == 1 else edges.repartitionByRange(parts, "u", "v")
        found = spread.mapInArrow(_forests, "node long, root long")
        if parts == 1:
            maps.append(materialize(found, "forest"))
            break
        found = materialize(found, "forest")
        best = materialize(found.groupBy("node").agg(F.min("root").alias("root")), "roots")
        maps.append(best)
        # the roots that one node has in several partitions belong together
        tied = materialize(found.alias("f").join(best.alias("g"), "node").select(F.col("g.root").alias("u"), F.col("f.root").alias("v")).filter("u <> v").distinct(), "ties")
        drop_path(spark, path)
        n = tied.count()
        if n == 0:
            break
        path = new_path(spark, "edges")
        if n <= edges_per_task:
            tied.write.parquet(path)
        else:
            tops = contracted(tied)
            maps.append(tops)
            left, right = tops.select(F.col("node").alias("u"), F.col("root").alias("_u")), tops.select(F.col("node").alias("v"), F.col("root").alias("_v"))
            over = tied.join(left, "u").join(right, "v").filter("_u <> _v").select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))
            over.distinct().write.parquet(path)
        edges = spark.read.schema("u long, v long").parquet(path)
        n = edges.count()
        if n == 0:
            break
    drop_path(spark, path)
    if told is not None:
        told["rounds"] = rounds
    out = maps[0]
    for later in maps[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        step = F.broadcast(step) if step.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else step
        out = out.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return out


def union_members(groups: DataFrame) -> DataFrame:
    """(root, copies): sizes of the groups, pre-aggregated before the shuffle like any count."""
    return groups.groupBy("root").agg(F.count(F.lit(1)).alias("copies"))
