import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.functions import search_text as S
from weftline.operators.graphs import article_graph
from weftline.operators.search import Request, of_kind, search, seeds


def test_queries_and_spans():
    assert S.parse_query('harbour "grain terminal" Opens') == (["harbour", "opens"], [["grain", "terminal"]])
    assert S.parse_query(None) == ([], []) and S.parse_query('""') == ([], [])
    assert S.parse_timespan("15min") == dt.timedelta(minutes=15) and S.parse_timespan("2 W") == dt.timedelta(weeks=2) and S.parse_timespan("1m") == dt.timedelta(days=30)
    for bad in ("", "soon", "5 fortnights", None):
        with pytest.raises(ValueError):
            S.parse_timespan(bad)
    p = S.request_params("grain", 900, "7d")
    assert p["maxrecords"] == "250" and p["timespan"] == "7d"
    utc = dt.timezone.utc
    q = S.request_params("grain", 10, "7d", (dt.datetime(2026, 1, 2, 3, tzinfo=utc), dt.datetime(2026, 1, 3, tzinfo=dt.timezone(dt.timedelta(hours=2)))))
    assert "timespan" not in q and (q["startdatetime"], q["enddatetime"]) == ("20260102030000", "20260102220000")


def test_text_of_hits(spark):
    rows = [(1, "Grain terminal opens. The harbour of Arn has a grain terminal now. Grain."), (2, None), (3, ""), (4, "Terminal grain only.")]
    q = F.lit("grain terminal of the harbour")
    df = spark.createDataFrame(rows, "id long, t string").select("id", S.term_overlap(q, F.col("t")).alias("terms"), S.best_sentence(q, F.col("t")).alias("best"), S.matches(F.col("t"), ["grain"], [["grain", "terminal"]]).alias("hit"))
    got = {r.id: (r.terms, r.best, r.hit) for r in df.collect()}
    assert got[1] == (["grain", "harbour", "terminal", "the"], "The harbour of Arn has a grain terminal now.", True)
    assert got[2] == ([], None, False) == got[3] and got[4][2] is False
    e = spark.range(1).select(S.explain(F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(-2.0)), F.array(F.lit("x"), F.lit("y"))).alias("e"), S.longest_title(F.array(F.lit("one two"), F.lit("one two x"), F.lit("one one one one"))).alias("t")).first()
    assert e.e == "b=-2.000, a=0.500; shares x, y" and e.t == "one two x"


@pytest.fixture(scope="module")
def corpus(spark):
    at = dt.datetime(2026, 5, 1)
    texts = ["Harbour opens grain terminal", "Grain terminal of Arn burns down", "Rail yard closes", "Grain terminal opens at the harbour again", None, "Grain prices fall"]
    rows = [(i, t, t and t + " as seen today.", f"s{i % 2}.example", "en" if i else "de", "trade" if i != 5 else None, at + dt.timedelta(days=i), i == 3, 0 if i == 3 else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:1], "id long, title string, excerpt string, source_domain string, language string, topic string, retrieved_at timestamp, is_near_duplicate boolean, duplicate_of_article_id long").cache()


def test_search(spark, corpus):
    ask = lambda **k: [r.doc_id for r in search(corpus, Request("grain terminal harbour", k=3, **k)).orderBy("rank").collect()]
    assert ask(rerank=False)[0] in (0, 3) and set(ask(rerank=False)) == {0, 1, 3}
    assert 3 not in ask(duplicates=False) and ask(language="DE") == [0] and 5 not in ask(topic="trade")
    assert set(ask(method="tfidf", rerank=False)) == {0, 1, 3} and set(ask(method="hash", rerank=False)) <= {0, 1, 3, 5} and ask(method="match") == [0, 3]
    assert ask(entity="arn", rerank=False) == [1]
    with pytest.raises(ValueError):
        ask(method="guess")
    assert search(corpus.limit(0), Request("grain")).count() == 0 and search(corpus, Request("")).count() == 0
    r = Request("grain terminal", walk=True)
    assert search(corpus, r).count() > 0 and r.notes
    stories = spark.createDataFrame([(1, "fire")], "doc_id long, story string")
    edges = article_graph(corpus.dropDuplicates(["id"]))
    got = {x.doc_id: x for x in search(corpus, Request("grain terminal", walk=True), stories, edges).collect()}
    assert got[1].story == "fire" and got[0].story is None and "shares grain, terminal" in got[0].explanation


def test_seeds_and_kinds(spark):
    hits = spark.createDataFrame([(1, 2.0), (2, -1.0)], "doc_id long, score double")
    assert {r.node: r.weight for r in seeds(hits).collect()} == {"article:1": 2.0, "article:2": 0.0}
    assert {r.weight for r in seeds(hits.filter("doc_id = 2")).collect()} == {1.0}
    mass = spark.createDataFrame([("article:7", 0.5), ("topic:x", 0.5)], "node string, mass double")
    assert [tuple(r) for r in of_kind(mass).collect()] == [(7, 0.5)]
