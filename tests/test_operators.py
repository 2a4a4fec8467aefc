import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.claims import entity_names, extract_claims, find_conflicts, group_claims
from weftline.operators.dedup import exact_groups, resolve_in_order, simhash_pairs, title_pairs, token_pairs
from weftline.operators.evaluation import bootstrap_ci, clustering_metrics, rank_metrics, topk_overlap
from weftline.operators.graphs import article_graph, components, pagerank
from weftline.operators.lexical import blend, bm25_topk, tfidf_topk
from weftline.operators.ordering import as_of, chronological_split, global_row_number, interval_overlap
from weftline.operators.stories import assign_stories, summarize, timeline
from weftline.operators.vectors import IvfIndex, cosine_topk, sparse_signs, svd_components, unit_rows


def test_global_row_number(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(50)) for i in range(500)]
    got = {r.i: r.rn for r in global_row_number(spark.createDataFrame(rows, "i long, x long"), "x", "i").collect()}
    want = {i: n for n, (_, i) in enumerate(sorted((x, i) for i, x in rows), 1)}
    assert got == want
    assert global_row_number(spark.createDataFrame([], "i long, x long"), "x", "i").count() == 0


@pytest.mark.parametrize("n, want", [(0, {}), (1, {"fit": 1}), (2, {"fit": 2}), (10, {"fit": 6, "validation": 2, "test": 2})])
def test_split(spark, n, want):
    df = spark.createDataFrame([(i, i * 7 % 10) for i in range(n)], "id long, t long")
    assert {r.split: r["count"] for r in chronological_split(df, "t", "id").groupBy("split").count().collect()} == want


def test_interval_overlap_against_nested_loops(spark):
    rng = random.Random(3)
    a = [(i, s, s + rng.randrange(40)) for i in range(60) for s in [rng.randrange(300)]]
    b = [(i, s, s + rng.randrange(40)) for i in range(60) for s in [rng.randrange(300)]]
    got = {(r.i, r.j) for r in interval_overlap(spark.createDataFrame(a, "i int, s long, e long"), spark.createDataFrame(b, "j int, lo long, hi long"), "s", "e", "lo", "hi", 17).collect()}
    assert got == {(i, j) for i, s, e in a for j, lo, hi in b if s <= hi and lo <= e}


def test_as_of(spark):
    l = spark.createDataFrame([("k", 5, 1), ("k", 1, 2), ("m", 9, 3), (None, 9, 4)], "key string, t long, id long")
    r = spark.createDataFrame([("k", 3, 10), ("k", 5, 11), ("m", 10, 12)], "key string, rt long, v long")
    assert {x.id: x.right_v for x in as_of(l, r, "key", "t", "rt", ["v"]).collect()} == {1: 11, 2: None, 3: None, 4: None}


def test_token_pairs_complete(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    sets = [rng.sample(words, rng.randrange(1, 12)) for _ in range(80)]
    sets += [s[:-1] or s for s in sets[:30]] + [[]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, t array<string>")
    got = {(r.a, r.b) for r in token_pairs(df, "id", "t", 0.8).collect()}
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8:
                assert (i, j) in got


def test_simhash_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(30)]
    near = []
    for x in base:
        for k in (1, 5, 6):
            y = x
            for bit in rng.sample(range(63), k):
                y ^= 1 << bit
            near.append(y)
    hs = base + near
    df = spark.createDataFrame(list(enumerate(hs)) + [(999, None)], "id long, h long")
    got = {(r.a, r.b): r.bits for r in simhash_pairs(df, "id", "h").collect()}
    want = {(i, j): bin(hs[i] ^ hs[j]).count("1") for i in range(len(hs)) for j in range(i + 1, len(hs)) if bin(hs[i] ^ hs[j]).count("1") <= 5}
    assert got == want


def test_titles(spark):
    head = "Northwind Labs releases Atlas 3 agent model for everyone"
    rows = [(1, head), (2, head + " | Moree Champion"), (3, head), (4, "Something else entirely happened in town today"), (5, None), (6, "")]
    got = {(r.a, r.b): r.score for r in title_pairs(spark.createDataFrame(rows, "id long, title string"), "id", "title").collect()}
    assert got == {(1, 2): 1.0}
    opposite = [(1, "Court upholds the merger of the two big banks"), (2, "Court blocks the merger of the two big banks")]
    assert title_pairs(spark.createDataFrame(opposite, "id long, title string"), "id", "title").count() == 0


def test_exact_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id long, k string")
    assert [tuple(r) for r in exact_groups(df, F.col("k")).collect()] == [(1, 2)]


def test_resolution_against_loop(spark):
    rng = random.Random(6)
    n = 60
    ids = [(i, rng.randrange(20)) for i in range(n)]
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(90)}
    got = {r.id: r.original_id for r in resolve_in_order(spark.createDataFrame(ids, "id long, ord long"), spark.createDataFrame(list(pairs), "a long, b long")).collect()}
    want = {}
    order = sorted(range(n), key=lambda i: (ids[i][1], i))
    for k, i in enumerate(order):
        originals = [j for j in order[:k] if tuple(sorted((i, j))) in pairs and want[j] == j]
        want[i] = originals[0] if originals else i
    assert got == want


def test_components_against_search(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, 500), (None, 3), (7, None)] + [(1000, 1000 + i) for i in range(1, 40)] + [(2000 + i, 2001 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


def test_pagerank_mass_and_dangling(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "d", 1.0), ("c", "a", 2.0)], "src string, dst string, weight double")
    rank, rounds = pagerank(e, spark.createDataFrame([("a", 1.0)], "node string, weight double"), tolerance=1e-6)
    mass = {r.node: r.mass for r in rank.collect()}
    assert abs(sum(mass.values()) - 1) < 1e-9 and mass["c"] == 0 and mass["a"] > mass["b"] > mass["d"] and rounds < 100


def test_graph_last_kind_wins(spark):
    a = spark.createDataFrame([(1, "X.example", "t", False, None), (2, None, None, True, 1)], "id long, source_domain string, topic string, is_near_duplicate boolean, duplicate_of_article_id long")
    e = {(r.src, r.dst): r.kind for r in article_graph(a).collect()}
    assert e[("article:2", "article:1")] == "near_duplicate_of" and e[("article:2", "source:unknown")] == "published_by" and e[("topic:t", "article:1")] == "about" and len(e) == 8


def test_rank_metrics(spark):
    hits = spark.createDataFrame([(1, d, i) for i, d in enumerate([3, 1, 2, 4], 1)], "query_id long, doc_id long, rank int")
    judged = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 9, 1.0)], "query_id long, doc_id long, relevance double")
    m = {r.query_id: r for r in rank_metrics(hits, judged, 2).collect()}
    assert m[1].precision == 0.5 and m[1].recall == 0.5 and m[1].rr == 0.5
    assert (m[2].precision, m[2].rr, m[2].ndcg) == (0.0, 0.0, 0.0)
    other = spark.createDataFrame([(1, d, i) for i, d in enumerate([1, 2, 9], 1)], "query_id long, doc_id long, rank int")
    base = spark.createDataFrame([(1, d, i) for i, d in enumerate([1, 2, 3], 1)], "query_id long, doc_id long, rank int")
    assert abs(topk_overlap(base, other, 3).first().overlap - 2 / 3) < 1e-9


def test_clustering_metrics_of_equal_and_split_partitions(spark):
    same = clustering_metrics(spark.createDataFrame([(i // 3, i // 3) for i in range(12)], "t int, p int"), "t", "p").first()
    assert same.f1 == 1 and same.b3_f1 == 1 and same.ari == 1 and same.fragmentation == 0
    split = clustering_metrics(spark.createDataFrame([(0, i % 2) for i in range(4)] + [(None, 1)], "t int, p int"), "t", "p").first()
    assert split.fragmentation == 1 and split.precision == 1 and abs(split.recall - 1 / 3) < 1e-9


def test_bootstrap_narrows(spark):
    values = lambda n: spark.createDataFrame([(i, float(i % 2)) for i in range(n)], "k long, v double")
    few, many = bootstrap_ci(values(20), "v", "k").first(), bootstrap_ci(values(600), "v", "k").first()
    assert few.lo <= few.mean <= few.hi and many.hi - many.lo < few.hi - few.lo
    assert bootstrap_ci(values(1), "v", "k").first().n == 1


def test_lexical_small(spark):
    docs = spark.createDataFrame([(1, "solar farm opens", "A solar farm opened near the town."), (2, "bridge closed", "The bridge is closed for repairs."), (3, None, None)], "id long, title string, body string")
    q = spark.createDataFrame([(7, "solar farm"), (8, ""), (9, None)], "query_id long, query string")
    assert [(r.query_id, r.doc_id) for r in bm25_topk(docs, "id", F.col("title"), F.col("body"), q, 3).collect()] == [(7, 1)]
    assert [(r.query_id, r.doc_id) for r in tfidf_topk(docs, "id", T.body_text(F.col("title"), F.col("body")), q, 3).collect()] == [(7, 1)]
    none = docs.limit(0)
    assert bm25_topk(none, "id", F.col("title"), F.col("body"), q, 3).count() == 0


def test_blend_scales_by_query(spark):
    hits = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5)], "query_id long, doc_id long, score double")
    mass = spark.createDataFrame([(2, 4.0)], "doc_id long, mass double")
    assert [(r.doc_id, r.rank) for r in blend(hits, mass).orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_search_in_blocks_equals_one_block(spark):
    rng = np.random.default_rng(0)
    v = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(60, [0.0] * 8), (61, None)]
    docs = spark.createDataFrame(v, "id long, v array<float>")
    q = docs.filter("id % 5 = 0").select(F.col("id").alias("query_id"), "v")
    one = cosine_topk(docs, q, "id", "v", 4).collect()
    many = cosine_topk(docs, q, "id", "v", 4, block=3).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
    assert cosine_topk(docs, q.limit(0), "id", "v", 4).count() == 0
    ivf = IvfIndex(cells=5).fit(docs, "id", "v")
    found = ivf.search(ivf.index(docs, "id", "v"), q, "query_id", "v", 4, 5)
    exact = cosine_topk(docs, q, "id", "v", 4, exclude_self=False)
    assert {(r.query_id, r.doc_id) for r in found.collect()} == {(r.query_id, r.doc_id) for r in exact.collect()}


def test_projection_properties(spark):
    r = np.array(sparse_signs(64, 16))
    assert 0.05 < (r != 0).mean() < 0.25
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 6)) @ rng.normal(size=(6, 10))
    docs = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    s = svd_components(docs, "v", 6)
    assert np.allclose(s.T @ s, np.eye(6), atol=1e-8) and np.allclose(x @ s @ s.T, x, atol=1e-6)
    assert unit_rows(np.zeros((1, 3))).sum() == 0


PORT = "Halden Port said the Corvo terminal handles 38.5 percent of the coastal grain trade."
CLAIMS = [("s", 1, "north", False, PORT), ("s", 2, "south", False, PORT), ("s", 3, "wire", True, "A rail union warned that Verro Freight could cut 900 jobs by 2031.")]


def _claims(spark, rows):
    return extract_claims(spark.createDataFrame(rows, "story string, article_id long, source_domain string, is_near_duplicate boolean, body string"), "body")


def test_claims(spark):
    rows = [("s", 1, "x", False, "One thing. " + PORT), ("s", 2, "x", False, None), ("s", 3, "x", False, ""), ("s", 4, "x", False, "Acme/Beta/Gamma/Delta/Eps/Zeta 2025."), ("s", 5, "x", False, "It rained. It was wet again in all of the town then.")]
    c = {r.article_id: r for r in _claims(spark, rows).collect()}
    assert set(c) == {1, 4} and (c[1].start, c[1].stop, c[1].claim) == (11, 11 + len(PORT), PORT)
    assert (c[1].subject, c[1].predicate, c[1].object, c[1].confidence) == ("Halden Port", "said", PORT[17:], 0.85) and c[1].entities == ["Corvo", "Halden Port"]
    assert c[4].predicate is None and c[4].object is None
    got = {r.status: (r.occurrences, r.domains, r.duplicates) for r in group_claims(_claims(spark, CLAIMS), "story").collect()}
    assert got == {"repeated": (2, 2, 0), "single_source": (1, 0, 1)}
    assert group_claims(_claims(spark, rows[1:3]), "story").count() == 0


def test_entities(spark):
    texts = ["Prices rose. On Friday boats of Verro Freight left, and Halden waited.", "Halden waited.", None, "", "The Port of Arn and Selby's Yard met; SHIPPING grew, NATO did not.", "Ice. Ice Ice. Then Ice fell on Ice."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").select("id", entity_names(F.col("t")).alias("e"))
    assert [r.e for r in df.orderBy("id").collect()] == [["Halden", "Verro Freight"], [], [], [], ["NATO", "Port of Arn and Selby's Yard"], ["Ice", "Ice. Ice Ice. Then Ice"]]


def test_conflicts(spark):
    rows = [("s", 1, "north", False, "Halden Port said the Corvo terminal handles 38.5 percent of the coastal grain trade."), ("s", 2, "south", False, "Rival shippers at Halden Port insist that it does not handle 38.5 percent in any year on record.")]
    assert [r.reason for r in find_conflicts(_claims(spark, rows), "story").collect()] == ["denied_value"]
    assert find_conflicts(_claims(spark, rows[:1]), "story").count() == 0
    far = [("s", 1, "north", False, "Verro Freight will close two yards in Arn and cut 900 jobs by spring."), ("s", 2, "south", False, "Unions fear Verro Freight will cut 1,400 jobs and close yards by autumn.")]
    assert [r.reason for r in find_conflicts(_claims(spark, far), "story").collect()] == ["different_values_for_same_unit"]
    split = [("s", 1, "north", False, PORT), ("s", 2, "south", False, PORT.replace("38.5", "21")), ("s", 3, "east", False, PORT.replace("38.5", "21"))]
    assert [(r.status, r.occurrences) for r in group_claims(_claims(spark, split), "story").collect()] == [("unclear", 3)]


def test_timeline_and_summary(spark):
    rows = [("s", 1, 10, False, "The plant opened on Monday in town. It employs two hundred people now."), ("s", 2, 20, False, "The plant opened on Monday in town. A second line will follow next year."), ("s", 3, 5, True, "The plant opened on Monday in town."), ("s", 4, None, False, None)]
    m = spark.createDataFrame(rows, "story string, id long, at long, is_near_duplicate boolean, body string")
    got = {r.id: (r.position, r.is_first_report, r.new_sentences, r.repeated_sentences) for r in timeline(m).collect()}
    assert got == {3: (1, False, 0, 0), 1: (2, True, 2, 0), 2: (3, False, 1, 1), 4: (4, False, 0, 0)}
    s = summarize(m).orderBy("position").collect()
    assert [r.article_id for r in s] == [2, 1, 1] and all(r.evidence_id.startswith(f"ev-{r.article_id}-") for r in s)


def test_online_assignment(spark):
    h = 3_600_000_000
    base = int(dt.datetime(2026, 5, 21, 6, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    a, b = "Halden Port opens a grain terminal for coastal ships this week", "Union warns freight yards in the north could lose 900 jobs"
    rows = [(1, a, a, base, "t", False, None), (2, a + " today", a + " today", base + 2 * h, "t", False, None), (3, a, a, base + 3 * h, "t", True, 1), (4, b, b, base + 30 * h, "t", False, None), (5, a, a, base + 900 * h, "t", False, None), (6, None, "", None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, body string, at long, topic string, is_near_duplicate boolean, duplicate_of long")
    got = {r.id: (r.story_id, r.method) for r in assign_stories(df).collect()}
    assert got == {1: (1, "new_story"), 2: (1, "online"), 3: (1, "duplicate_link"), 4: (4, "new_story"), 5: (5, "new_story")}


def test_simhash_pairs_in_large_groups_come_once(spark):
    """Groups beyond the bound for tiles and rows that share many keys: each pair once. The plan stays small, as the driver holds every version of it."""
    rng = random.Random(8)
    hs = sorted({sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(1500)})
    hs = [h - (1 << 64) if h >> 63 else h for h in hs]
    df = simhash_pairs(spark.createDataFrame(list(enumerate(hs)), "id long, h long"), "id", "h")
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = sorted((r.a, r.b, r.bits) for r in df.collect())
    bits = lambda i, j: bin((hs[i] ^ hs[j]) & (1 << 64) - 1).count("1")
    assert got == [(i, j, bits(i, j)) for i in range(len(hs)) for j in range(i + 1, len(hs)) if bits(i, j) <= 5]


def test_lexical_search_shuffles_no_pairs(spark, monkeypatch):
    """Each query meets every document in one of its words, in several blocks: against loops, ties by id. Before, one row a pair was shuffled."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    texts = {i: ("all " + " ".join(rng.choices(words, k=rng.randint(1, 6))), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(300)}
    docs = spark.createDataFrame([(i, *t) for i, t in texts.items()], "id long, title string, body string").repartition(5)
    asked = {q: "all " + " ".join(rng.choices(words, k=3)) for q in range(20)}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    monkeypatch.setattr("weftline.operators.lexical.BLOCK_POSTINGS", 200)

    def best(vectors, q):
        score = {i: sum(q[t] * v[t] for t in q if t in v) for i, v in vectors.items()}
        return [i for i in sorted(score, key=lambda i: (-round(score[i], 8), i)) if score[i] > 0][:4]

    tf = {i: {w: 2 * a.split().count(w) + b.split().count(w) for w in {*a.split(), *b.split()}} for i, (a, b) in texts.items()}
    df = {w: sum(w in v for v in tf.values()) for w in [*words, "all"]}
    avg = sum(sum(v.values()) for v in tf.values()) / 300
    bm = {i: {w: f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(v.values()) / avg)) for w, f in v.items()} for i, v in tf.items()}
    hits = bm25_topk(docs, "id", F.col("title"), F.col("body"), queries, 4)
    assert "Join" not in hits._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {q: best(bm, {w: math.log(1 + (300 - df[w] + 0.5) / (df[w] + 0.5)) for w in set(t.split())}) for q, t in asked.items()}

    def terms(x):
        t = [w for w in x.replace(".", " ").split()]
        return t + [f"{a} {b}" for a, b in zip(t, t[1:])] if len(t) > 1 else t

    counts = {i: Counter(terms(f"{a}. {b}")) for i, (a, b) in texts.items()}
    df = Counter(t for c in counts.values() for t in c)
    weigh = lambda c: {t: (1 + math.log(f)) * (math.log(301 / (1 + df[t])) + 1) for t, f in c.items() if t in df}
    unit = lambda v: {t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()}
    got = {}
    for r in tfidf_topk(docs, "id", T.body_text(F.col("title"), F.col("body")), queries, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {q: best({i: unit(weigh(c)) for i, c in counts.items()}, unit(weigh(Counter(terms(t))))) for q, t in asked.items()}


def test_token_pairs_leave_the_lists_verified(spark):
    """Sets that share rare tokens but are not similar are no pairs, and shingles are not carried through the joins of titles."""
    rng = random.Random(4)
    sets = {i: rng.sample(range(14), rng.randint(1, 12)) for i in range(250)}
    df = spark.createDataFrame([(i, [f"t{x}" for x in s]) for i, s in sets.items()], "id long, t array<string>")
    got = sorted((r.a, r.b) for r in token_pairs(df, "id", "t", 0.8).collect())
    near = lambda a, b: len({*a} & {*b}) >= 0.8 * len({*a} | {*b}) - 1e-9
    assert got == [(i, j) for i in sets for j in sets if i < j and near(sets[i], sets[j])]
    plan = title_pairs(spark.createDataFrame([(1, "a b c")], "id long, title string"), "id", "title")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS s_a#" not in plan and "AS v_a#" in plan
