import random

import pytest

from weftline.llm.bpe import DEFAULT_PATH, encoder
from weftline.llm.encoding import encode_texts
from weftline.llm.reading import assign_levels, english_words, fit, read_models


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(DEFAULT_PATH)
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


def test_equals_library_on_random_texts(library):
    rng = random.Random(1)
    letters = "aaaabbc  \n\t<|endoftext|>éßж日🙂‍ 　'sll0123.,-_ABtheingion "
    xs = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)]
    xs += ["a" * 3000, " " * 2000, "ab" * 2000, "\n" * 500, "<|endoftext|>", " ", "a ", "a  b ", " \n a", "'''", "日本語" * 500]
    assert encoder().encode_batch(xs) == library(xs)


def test_equals_library_on_documents(library):
    import duckdb

    xs = [r[0] for r in duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    assert encoder().encode_batch(xs) == library(xs)


def test_rows_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "the cat", "z"), (1, "the cat", "z"), (2, None, "z"), (3, "", "z"), (None, "x", "z")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, tuple(r.ids)) for r in encode_texts(df, "doc_id", "text").collect()), key=str)
    one = tuple(encoder().encode("the cat"))
    assert got == sorted([(1, one), (1, one), (2, ()), (3, ()), (None, tuple(encoder().encode("x")))], key=str)
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0


def refs():
    import duckdb

    return duckdb.connect().execute("SELECT text, band FROM '/root/testdata/sf0.001/reading_refs.parquet' ORDER BY ref_id").fetchall()


def test_held_out_accuracy():
    from weftline.llm.cleaning import words

    rows, right = refs(), 0
    for k in range(8):
        m = fit([r for i, r in enumerate(rows) if i % 8 != k])
        right += sum(m.level(words(t)) == b for i, (t, b) in enumerate(rows) if i % 8 == k)
    assert right / len(rows) >= 0.95


def test_levels_of_odd_texts(spark):
    rows = refs()
    m = fit(rows)
    easy, hard = next(t for t, b in rows if b == 1), next(t for t, b in rows if b == 4)
    table = "\n".join(f"SESK\t{i}\t192.17\t+4.7%" for i in range(200))
    german = "Das Museum in Nathorm eröffnet die Trasse am Fluss zum halben Preis. " * 20
    docs = [(1, easy), (2, hard.upper().replace(".", "").replace(",", "")), (3, None), (4, ""), (5, "The cat sat."), (6, table), (7, german), (8, "<p>" + hard.replace(" ", "\n<b>x</b> ", 1) + "</p>"), (9, table + "\n" + easy), (10, easy * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.band for r in assign_levels(df, "doc_id", "text", m).collect()}
    assert got == {1: 1, 2: 4, 8: 4, 9: 1, 10: 1}
    assert english_words(None, m) == []
    assert assign_levels(df.limit(0), "doc_id", "text", m).count() == 0
    none = spark.createDataFrame([(1, None, 1), (2, "x", None)], "ref_id long, text string, band long")
    assert assign_levels(df, "doc_id", "text", read_models(none, "ref_id", "text", "band")).count() == 0
