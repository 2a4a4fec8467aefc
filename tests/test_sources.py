import json

from weftline.sources.feeds import changed_keys, enrich, read_artlist, read_benchmark, read_feed, read_fixtures, read_judgments, read_story_labels, upsert
from weftline.streaming import jobs


def test_artlist_and_feed(spark, tmp_path):
    (tmp_path / "ai.gdelt.json").write_text(json.dumps({"articles": [{"url": "https://a.example/x", "title": "T", "seendate": "20260818T060000Z", "domain": "", "language": "English"}, {"title": "no address"}, 7, {"url": ""}]}))
    (tmp_path / "bad.gdelt.json").write_text("[1, 2]")
    (tmp_path / "ai.rss.xml").write_text("<?xml version='1.0'?><rss><channel><title>c</title><item><title>One</title><link>https://b.example/1</link><pubDate>Tue, 18 Aug 2026 06:00:00 +0000</pubDate><description>&lt;p&gt;Some &lt;b&gt;text&lt;/b&gt;&lt;/p&gt;</description></item><item><title>no link</title></item></channel></rss>")
    rows = {r.url: r for r in read_artlist(spark, f"{tmp_path}/*.gdelt.json").collect()}
    assert list(rows) == ["https://a.example/x"] and rows["https://a.example/x"].source_domain == "a.example" and rows["https://a.example/x"].topic == "ai"
    feed = read_feed(spark, f"{tmp_path}/*.rss.xml").collect()
    assert [(r.url, r.excerpt) for r in feed] == [("https://b.example/1", "Some text")]
    assert read_fixtures(spark, str(tmp_path)).count() == 2


def test_labels_judgments_benchmark(spark, tmp_path):
    (tmp_path / "l.csv").write_text("canonical_url,story_label,topic\n https://a , s1 ,t\n,s2,t\nhttps://b,,t\n")
    assert [tuple(r) for r in read_story_labels(spark, f"{tmp_path}/l.csv").collect()] == [("https://a", "s1", "t")]
    (tmp_path / "j.csv").write_text("query,article_id,relevance,reviewer,notes\nq,1,2,x,\nq,zz,1,x,\nq,2,0,x,\n")
    assert [tuple(r) for r in read_judgments(spark, f"{tmp_path}/j.csv").collect()] == [("q", 1, 2.0)]
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps({"_id": str(i), "title": "t", "text": "x"}) for i in range(6)))
    (tmp_path / "queries.jsonl").write_text(json.dumps({"_id": "q1", "text": "x"}))
    (tmp_path / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\nq1\t5\t1\nq1\t2\t0\n")
    corpus, queries, judged = read_benchmark(spark, str(tmp_path), max_documents=2)
    assert {r.doc_id for r in corpus.collect()} == {"5", "0"} and queries.count() == 1 and judged.count() == 1


def test_sinks_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k long, v string, n long")
    new = spark.createDataFrame([(1, "c", 2), (2, "d", 4), (3, "e", 1)], "k long, v string, n long")
    once = upsert(old, new, ["k"], "n")
    assert sorted(map(tuple, once.collect())) == [(1, "c", 2), (2, "b", 5), (3, "e", 1)]
    assert sorted(map(tuple, upsert(once, new, ["k"], "n").collect())) == sorted(map(tuple, once.collect()))
    o = spark.createDataFrame([("u", "", None), ("w", "x", "y")], "url string, title string, excerpt string")
    n = spark.createDataFrame([("u", "t", "e"), ("w", "other", "other"), ("z", "q", None)], "url string, title string, excerpt string")
    merged = enrich(o, n, "url")
    assert sorted(map(tuple, merged.collect()), key=str) == [("u", "t", "e"), ("w", "x", "y"), ("z", "q", None)]
    add, gone = changed_keys(o, merged)
    assert add.count() == 2 and gone.count() == 1


def test_stream_agrees_with_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").selectExpr("cast(ts as timestamp) ts", "event_type", "value")
    for n, part in enumerate(e.randomSplit([1.0, 1.0], 1)):
        part.write.parquet(f"{tmp_path}/in/{n}")
    whole = {(r.start, r.event_type): (r.n, r.total) for r in jobs.tumbling(e).collect()}
    stream = jobs.read_events_stream(spark, f"{tmp_path}/in/*", "ts timestamp, event_type string, value double")
    jobs.run_available(jobs.tumbling(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r.start, r.event_type): (r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    last = max(s for s, _ in whole)
    assert got and all(whole[k] == v for k, v in got.items())
    assert {k for k in whole if (last - k[0]).total_seconds() > 3600 * 2} <= set(got)
