import random

from pyspark.sql import functions as F

from weftline.llm.formatting import address_key, collapse
from weftline.llm.forests import connect, local_forest


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_connect_in_many_bounded_partitions(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    edges += [(1000, 1000 + i) for i in range(1, 90)]  # a hub with a third of all pairs
    edges += [(5000 + i, 5001 + i) for i in range(60)]  # a chain
    edges += [(b, a) for a, b in edges[:40]] + [(None, 1), (2, None), (9, 9)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").withColumn("root", F.lit("x"))
    for bound in (20, 100, 1_000_000):
        got = {r.node: r.root for r in connect(df, "a", "b", edges_per_task=bound).collect()}
        assert got == roots(edges)


def test_rounds_grow_with_the_logarithm_of_a_chain(spark):
    """Records of batch k match those of batch k - 1, and no partition holds two batches: 17 layers end in five rounds at most."""
    layer = 30
    for layers in (5, 17):
        edges = [(1000 * k + i, 1000 * (k + 1) + i) for k in range(layers) for i in range(layer)]
        told = {}
        got = {r.node: r.root for r in connect(spark.createDataFrame(edges, "a long, b long"), "a", "b", edges_per_task=layer, told=told).collect()}
        assert got == roots(edges) and told["rounds"] <= 5


def test_connect_nothing(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert connect(none, "a", "b").count() == 0
    assert connect(spark.createDataFrame([(None, None), (3, 3)], "a long, b long"), "a", "b").count() == 0


def test_local_forest():
    import numpy as np

    node, root = local_forest(np.array([5, 7, 9]), np.array([7, 3, 8]))
    assert dict(zip(node.tolist(), root.tolist())) == {3: 3, 5: 3, 7: 3, 8: 8, 9: 8}


SAME = ["https://a.example/x-y?id=7&section=News", " HTTPS://A.Example/x%2Dy/?section=news&amp;id=7# ", "<https://a.example/x_y?id=7&section=news>", "https://a.example//x­y?id=7&section=news​", "'https://a.example/x\n-y?section=news&id=7'", "https://a.example/x%252Dy?id=7&section=news&"]
OTHER = ["https://a.example/x-y?id=8&section=news", "http://a.example/x-y?id=7&section=news", "https://a.example/x-y?id=7", "https://a.example/x-y?section=7&id=news", "https://a.example/x-y?id=7&section=news&page=2", "https://b.example/x-y?id=7&section=news"]


def test_address_keys(spark):
    df = spark.createDataFrame([(x,) for x in SAME + OTHER], "u string").select("u", address_key(F.col("u")).alias("k"))
    keys = {r.u: r.k for r in df.collect()}
    assert len({keys[u] for u in SAME}) == 1
    assert len({keys[u] for u in OTHER} | {keys[SAME[0]]}) == len(OTHER) + 1
    odd = spark.createDataFrame([(None,), ("",), (" ​",), ("%zz%41",), ("ü%C3%BC",)], "u string").select(address_key(F.col("u")).alias("k"))
    assert [r.k for r in odd.collect()] == [None, "", "", "zz41", "üü"]


def test_collapse_hot_and_cold_alike(spark):
    rows = [(i, "hot") for i in range(5, 900)] + [(2000 + i, f"k{i % 300}") for i in range(500)] + [(1, None), (None, "null id")]
    df = spark.createDataFrame(rows, "id long, key string").withColumn("copies", F.lit("clash"))
    got = {r.key: (r.id, r.copies) for r in collapse(df, "key", "id").collect()}
    want = {}
    for i, k in rows:
        if k is not None:
            m, n = want.get(k, (None, 0))
            want[k] = (i if m is None else m if i is None else min(m, i), n + 1)
    assert got == want
    assert collapse(df.limit(0), "key", "id").count() == 0
