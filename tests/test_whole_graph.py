from weftline.operators.graphs import article_graph
from weftline.plans.catalog import queries


def test_all_kinds_of_nodes_and_edges(spark, data):
    e = queries()["evidence_graph_edges"](spark, data).select("src", "dst", "kind").collect()
    assert {r.src.split(":")[0] for r in e} == {"article", "source", "topic", "story", "entity", "claim"}
    assert {"published_by", "about", "belongs_to", "mentions", "reports"} <= {r.kind for r in e}
    assert {(r.src, r.dst) for r in e} == {(r.dst, r.src) for r in e}


def test_weights_of_evidence(spark):
    a = spark.createDataFrame([(1, "x.example", None, False, None)], "id long, source_domain string, topic string, is_near_duplicate boolean, duplicate_of_article_id long")
    said = spark.createDataFrame([(1, "c", False, 0.0), (1, "d", True, 0.01), (1, "e", False, 0.9)], "article_id long, claim string, disputes boolean, confidence double")
    got = {r.dst: (r.kind, r.weight) for r in article_graph(a, evidence=said).collect() if r.src == "article:1"}
    assert got == {"source:x.example": ("published_by", 1.0), "claim:c": ("reports", 0.5), "claim:d": ("disputes", 0.05), "claim:e": ("reports", 0.9)}
