"""Suffix-array history: incremental reads, reopening, short texts, hot texts."""

import random

import numpy as np

from weftline.llm.headlines import same_headline
from weftline.llm.segments import TextHistory, entries_of, letter_counts, letters_apart, searches_of

LETTERS = "abcdefghijklmnoprstuvwz"


def _word(rng, n=8):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def _frame(spark, rows):
    return spark.createDataFrame(rows, "text string, exact boolean, ts long")


def _slipped(rng, word):
    i = rng.randrange(1, len(word) - 2)
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :]])


def test_every_text_of_slips_is_met_by_a_search():
    """Also where texts are short, slips are in every word, and one word is cut in two."""
    rng = random.Random(5)
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 11, 14]:
        for _ in range(40):
            a = [_word(rng, rng.choice([6, 8, 40])) for _ in range(n)]
            b = list(a)
            for i in rng.sample(range(n), min(n, rng.randrange(0, 4))):
                b[i] = _slipped(rng, b[i])
            if n > 1 and rng.random() < 0.3:
                i = rng.randrange(n)
                b = a[:i] + [a[i][:3], a[i][3:]] + a[i + 1 :]
            if same_headline(a, b):
                have = [k for k, _ in entries_of(" ".join(a), 3)]
                assert any(h.startswith(k) for k, _, _ in searches_of(" ".join(b), 3) for h in have), (a, b)


def test_short_headlines(spark):
    rows = [("senate passes rural bridge", False, 1), ("senatee passes rural brigde", False, 2), ("bridge", False, 1), ("brigde", False, 3), ("rain", False, 4), ("ruin", False, 5), ("lighthouse keeper", False, 1), ("light house keeper", False, 2)]
    h = TextHistory(spark)
    h.add(_frame(spark, rows))
    got = {r.text: r.first_ts for r in h.repeats(_frame(spark, rows)).collect()}
    assert got == {"senatee passes rural brigde": 1, "brigde": 1, "light house keeper": 1}


def test_batches_reopening_and_exact_items(spark):
    rng = random.Random(6)
    texts = [" ".join(_word(rng) for _ in range(9)) for _ in range(40)]
    h = TextHistory(spark, entries_per_file=100)
    for k in range(5):
        h.add(_frame(spark, [(t, False, 10 * k + 1) for t in texts[8 * k : 8 * k + 8]] + [(f"https://a.example/{k}", True, 10 * k), (texts[0], False, 10 * k + 5), (None, False, 1), ("", True, 1)]))
    assert [s.level for s in h.segments] == [2, 0]
    again = TextHistory.open(spark, h.path)
    assert [(s.level, s.path, s.rows, list(map(tuple, s.files))) for s in again.segments] == [(s.level, s.path, s.rows, list(map(tuple, s.files))) for s in h.segments]
    slip = texts[20].split(" ")
    slip[3] = slip[3][:4] + slip[3][5:]
    asked = [(texts[0], False, 100), (texts[39], False, 100), (" ".join(slip), False, 100), (" ".join(slip), False, 99), ("https://a.example/3", True, 100), ("https://a.example/9", True, 100), (texts[3], False, 1), (None, None, 7)]
    got = {(r.text, r.exact): r.first_ts for r in again.repeats(_frame(spark, asked)).collect()}
    assert got == {(texts[0], False): 1, (texts[39], False): 41, (" ".join(slip), False): 21, ("https://a.example/3", True): 30}
    again.add(_frame(spark, [(" ".join(slip), False, 200)]))
    assert [s.level for s in again.segments] == [2, 1] and TextHistory.open(spark, h.path).segments[0].level == 2
    none = TextHistory(spark)
    assert none.repeats(_frame(spark, asked)).count() == 0
    none.add(_frame(spark, []))
    assert none.repeats(_frame(spark, asked)).count() == 0


def test_rows_read_do_not_follow_the_history(spark):
    """Ten times the history, the same batch: the rows that a batch reads stay about the same."""
    rng = random.Random(7)
    read = []
    for size in (6000, 60000):
        h = TextHistory(spark)
        h.add(_frame(spark, [(" ".join(_word(rng, 6) for _ in range(9)), False, k) for k in range(size)]).repartition(4))
        new = _frame(spark, [(" ".join(_word(rng, 6) for _ in range(9)), False, size + k) for k in range(5)])
        assert h.repeats(new).count() == 0
        read.append(h.rows_read.value)
    assert 0 < read[1] < 2.5 * read[0]


def test_hot_stretch(spark):
    """A third of all texts begins alike; each still meets its own repeat only."""
    rng = random.Random(8)
    texts = ["weeks before " + " ".join(_word(rng, 5) for _ in range(7)) for _ in range(400)]
    h = TextHistory(spark, entries_per_file=500)
    h.add(_frame(spark, [(t, False, k) for k, t in enumerate(texts)]))
    new = _frame(spark, [(t[:-1], False, 1000) for t in texts])
    got = {r.text: r.first_ts for r in h.repeats(new).collect()}
    assert got == {t[:-1]: k for k, t in enumerate(texts)}


def test_texts_of_one_pattern_are_not_fetched(spark):
    """Headlines that differ in names only meet in the arrays by the thousand; none of them is fetched, and each still meets its own slipped repeat."""
    rng = random.Random(9)
    texts = [f"{_word(rng)} {_word(rng)} wins approval solar farm {_word(rng)} despite local objections" for _ in range(150)]
    h = TextHistory(spark)
    h.add(_frame(spark, [(t, False, k) for k, t in enumerate(texts[:100])]))
    assert h.repeats(_frame(spark, [(t, False, 1000) for t in texts[100:]])).count() == 0
    assert h.compared.value <= 5
    new = [t.replace("approval", "aproval").replace("objections", "objecitons") for t in texts[:20]]
    assert {r.text: r.first_ts for r in h.repeats(_frame(spark, [(t, False, 1000) for t in new])).collect()} == {t: k for k, t in enumerate(new)}


def test_letters_of_repeats_are_near():
    """What same_headline accepts differs by two letters a slip at most, or has other numbers of words, or a slipped filler (0)."""
    rng = random.Random(10)
    for n in (1, 3, 6, 10):
        for _ in range(200):
            a = [_word(rng, rng.choice([4, 6, 9])) for _ in range(n)]
            b = list(a)
            for i in rng.sample(range(n), min(n, rng.randrange(0, 4))):
                b[i] = _slipped(rng, _slipped(rng, b[i]) if rng.random() < 0.5 and len(b[i]) > 4 else b[i])
            if same_headline(a, b):
                x, y = (np.array(letter_counts([" ".join(t)])) for t in (a, b))
                assert letters_apart(x, y)[0] <= 6, (a, b)
    assert letter_counts(["mill opens reportedyl today", "mill opens", ""])[0::2] == [0, 0]
