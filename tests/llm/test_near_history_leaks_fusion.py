import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm.cleaning import words
from weftline.llm.fusion import boilerplate, chosen, fuse, own_text
from weftline.llm.headlines import Headlines, same_headline, slip
from weftline.llm.leaks import WordIds, find_leaks, holds
from weftline.llm.near import near_pairs
from weftline.llm.q_history import repeated_articles

VOCABULARY = [f"{a}{b}" for a in ("ba", "de", "fi", "go", "ku", "la", "mo", "ne") for b in ("rin", "sol", "tam", "vex", "wun", "zor", "pel", "qua", "hib", "jom")]


def test_words():
    assert words("<p>The&nbsp;<b>Quick</b>-Fox's­ tail</p>") == ["the", "quick", "foxs", "tail"]
    assert words(None) == [] and words("") == [] and words("…!") == []


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        base = rng.sample(VOCABULARY, 24)
        texts.append(base)
        for k in (1, 3, 5, 9):
            texts.append(base[k:] + rng.sample(VOCABULARY, k))
    rows = [(i, " ".join(t[:5]).upper(), ", ".join(t[5:])) for i, t in enumerate(texts)]
    rows += [(1000, rows[0][1].lower(), rows[0][2]), (1001, None, None), (1002, "", ""), (1003, None, rows[4][2]), (1000, rows[0][1].lower(), rows[0][2])]
    df = spark.createDataFrame(rows, "id long, title string, excerpt string").withColumn("w", F.lit(1))
    membership, pairs = near_pairs(df, "id", ["title", "excerpt"], 0.7)
    group = {r.id: r["class"] for r in membership.collect()}
    assert group[1000] == 0 and 1001 not in group and 1002 not in group
    sets = {i: set(words(f"{t or ''} {e or ''}")) for i, t, e in rows}
    reps = sorted(set(group.values()))
    want = {(a, b) for n, a in enumerate(reps) for b in reps[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7 - 1e-9}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    m, p = near_pairs(df.limit(0), "id", ["title", "excerpt"], 0.7)
    assert m.count() == 0 and p.count() == 0


MASTS = ["The Dritur Post", "Faro Review"]
HEAD = "Krorsaent Energy wins approval for solar farm in Kruhota despite 444 objections"
SAME = [HEAD.upper(), "BREAKING: " + HEAD, "[Video] " + HEAD, "UPDATE 2-" + HEAD, HEAD + " - The Dritur Post", HEAD + " | Faro today Review", HEAD.replace("approval", "aproval"), HEAD.replace("objections", "objecitons"), HEAD.replace(" for", ""), "“" + HEAD + "”", HEAD.replace("wins", "now wins"), HEAD + " …"]
OTHER = [HEAD.replace("wins", "loses"), HEAD.replace("444", "445"), HEAD.replace("Kruhota", "Naelik"), HEAD.replace("Krorsaent", "Bisel")]


def test_headlines():
    h = Headlines(MASTS)
    base = h.words(HEAD)
    for t in SAME:
        assert same_headline(base, h.words(t)), t
    for t in OTHER:
        assert not same_headline(base, h.words(t)), t
    assert h.words(None) == [] and h.words("n/a") == [] and h.words(" ") == []
    assert h.words("Plant gets $793m") == h.words("Plant gets 793 million") and h.words("up 5%") == h.words("up 5 percent")
    assert slip("approval", "aproval") and slip("workers", "wokrers") and not slip("passes", "misses") and not slip("444", "445") and not slip("gets", "getz")


def test_history_batch_by_batch(spark):
    rng = random.Random(3)
    h = Headlines(MASTS)
    start = dt.datetime(2025, 9, 1)
    names = [x.capitalize() for x in VOCABULARY]
    rows, i = [], 0
    for k in range(60):
        head = f"{rng.choice(names)} {rng.choice(names)} wins approval for {rng.choice(['solar farm', 'rail yard'])} in {rng.choice(names)} despite {rng.randrange(900)} objections"
        for copy in range(rng.randrange(1, 4)):
            i += 1
            t = rng.choice([head, head.upper(), "WATCH: " + head, head.replace("approval", "appproval"), head + " - Faro Review"])
            rows.append((i, t, f"https://s{rng.randrange(3)}.example/{k}?id={copy}&utm_source=x", start + dt.timedelta(days=rng.randrange(300), seconds=i)))
    rows += [(900, None, "https://q.example/1", start), (901, "", "http://www.q.example/1/#top", start + dt.timedelta(days=200)), (902, None, None, start + dt.timedelta(days=3)), (903, HEAD, None, None)]
    rows += [rows[0], (904, HEAD, "https://z.example/a", start), (905, HEAD, "https://z.example/b", start)]  # same moment: neither is earlier
    df = spark.createDataFrame(rows, "id long, title string, url string, retrieved_at timestamp")
    got = {r.article_id for r in repeated_articles(df, MASTS, batch_days=40).collect()}
    import re

    key = lambda u: re.sub(r"^https?://(www\.)?", "", u).split("#")[0].replace("&utm_source=x", "").rstrip("/") if u else None
    want = set()
    for a in rows:
        for b in rows:
            if a[3] and b[3] and b[3] < a[3] and ((a[2] and key(a[2]) == key(b[2])) or (h.words(a[1]) and h.words(b[1]) and same_headline(h.words(a[1]), h.words(b[1])))):
                want.add(a[0])
    assert got == want and 901 in got and 905 not in got
    assert repeated_articles(df.limit(0), MASTS).count() == 0


def _passage(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(4)
    item, short = _passage(rng, 45), _passage(rng, 30)
    edited = item[5:30].copy()
    edited[8] = "changed"
    del edited[17]
    parts = short[16:] + short[:16]
    fill = lambda n: " ".join(_passage(rng, n))
    docs = [
        (1, f"{fill(80)} {' '.join(item)} {fill(50)}"), (2, f"{fill(30)}\n<p>{' '.join(item[10:31]).upper()}</p>. {fill(9)}"), (3, f"{fill(30)} {' '.join(edited)} {fill(40)}"), (4, f"{fill(20)} {'. '.join([' '.join(parts[:14]), ' '.join(parts[14:])])} {fill(30)}"),
        (5, f"{fill(40)} {' '.join(item[3:16])} {fill(40)}"), (6, fill(300)), (7, None), (8, ""), (9, " ".join(f"{w} {rng.choice(VOCABULARY)}" for w in item)), (10, f"{fill(30000)} {' '.join(item)} {fill(2000)}"), (1, f"{fill(80)} {' '.join(item)} {fill(50)}"),
    ]
    items = [(1, " ".join(item)), (2, "“" + ", ".join(item).upper() + "”"), (3, " ".join(short)), (4, None), (5, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("w", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in find_leaks(d, "doc_id", "text", i, "item_id", "text").collect())
    assert got == sorted([(1, 1), (1, 2), (1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (4, 3), (10, 1), (10, 2)])
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(d, "doc_id", "text", i, "item_id", "text", max_items=2).collect()) == got  # items in blocks
    assert find_leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert find_leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_leaks_with_two_whole_shingles(spark):
    """Passages whose edits leave just two or three shingles next to each other: runs of 4, 4, 4, 8 words with three changes, and of 3, 4, 4, 7 with two and a seam."""
    rng = random.Random(11)
    item = rng.sample(VOCABULARY, 40)
    fill = lambda n: " ".join(f"filler{rng.randrange(10**6)}" for _ in range(n))
    three = [*item[5:9], "xa", *item[10:14], "xb", *item[15:19], "xc", *item[20:28]]
    seam = [*item[21:25], "xa", *item[26:33], *item[10:13], "xb", *item[14:18]]
    thin = [*item[5:9], "xa", *item[10:14], "xb", *item[15:19], "xc", *item[20:24]]
    docs = [(1, f"{fill(40)} {' '.join(three)} {fill(40)}"), (2, f"{fill(40)} {' '.join(seam)} {fill(40)}"), (3, f"{fill(40)} {' '.join(thin)} {fill(40)}")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted(r.doc_id for r in find_leaks(d, "doc_id", "text", i, "item_id", "text").collect()) == [1, 2]


def test_holds_is_about_density():
    w = WordIds()
    a = w.of(" ".join(VOCABULARY[:40]))
    assert holds(a[5:26], a) and not holds(a[5:20], a) and not holds(np.delete(a[5:30], [2, 5, 8, 11, 14, 17, 20]), a)


def test_own_text(spark):
    promo = "Sign up for our evening letter to get more stories like this."
    rows = [(1, f"The mill opened today. It is large… {promo}"), (2, "The mill opened today. It is large and it was costly. Read next: Ten mills; Twenty mills"), (3, "No description available."), (4, None), (5, "n/a"), (6, "The mill (more)")]
    rows += [(100 + k, f"Story number {k} is about something. Common closing line of the house.") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, excerpt string")
    common = boilerplate(df, "excerpt", share=0.2)
    assert [r.sentence for r in common.collect()] == ["Common closing line of the house."]
    own = {r.id: r.own for r in own_text(df, "id", "excerpt", common).collect()}
    assert own[2] > own[1] > own[6] > 0 and not {3, 4, 5} & set(own) and own[101] == own[102]


def test_copies_of_one_text_make_no_boilerplate(spark):
    """A third of all rows are edited copies of one text, tied or not: their body is its own. A rare promotional line of five texts is not."""
    rng = random.Random(7)
    body = "The council of Arvik bought the old mill by the river for nine million crowns. Work on its roof begins after the long winter holidays."
    heads = ["A mill changes hands in Arvik today", "A mil changes hands in Arvik today", "(Corrected) A mill changes hands in Arvik", "A  mill changes hands in Arvik todya", "Today a mill changes hands in Arvik", "One mill changes hands in Arvik today", "Mill changes hands in Arvik today", "A mill changess hands in Arvik today"]
    rows = [(k, 1 if tied else None, f"{h}. {body}") for tied in (True, False) for k, h in enumerate(heads, 100 if tied else 200)]
    line = "Reports of this desk reach you every evening."
    other = [" ".join(rng.sample(VOCABULARY, 12)).capitalize() for _ in range(1400)]
    rows += [(1000 + k, None, f"{t}. {' '.join(rng.sample(VOCABULARY, 9)).capitalize()}. {line if k < 5 else ''}") for k, t in enumerate(other)]
    rows += [(5000 + k, None, f"{t}. The (more)") for k, t in enumerate(other[:9])]
    df = spark.createDataFrame(rows, "id long, group long, excerpt string")
    assert [r.sentence for r in boilerplate(df, "excerpt", group="group").collect()] == [line]
    few = df.filter("id < 300 OR id >= 1000 AND id < 1030")
    common = boilerplate(few, "excerpt", group="group")
    assert [r.sentence for r in common.collect()] == [line]
    own = {r.id: r.own for r in own_text(few, "id", "excerpt", common).collect()}
    assert own[100] > len(body) / 2 and own[200] == own[100]
    assert boilerplate(df.limit(0), "excerpt", group="group").count() == 0


def test_fuse_prefers_then_votes(spark):
    rows = [("g", "f", "s1", 1, "old", 1), ("g", "f", "s2", 2, "new", 2), ("g", "f", "s3", 3, "new", 2), ("h", "f", "s1", 9, "x", 5), ("h", "f", "s2", 8, "y", 5), ("h", "f", "s3", 7, "y", 5), ("k", "f", "s1", 4, None, 5), ("k", "f", "s1", 5, "z", None)]
    c = spark.createDataFrame(rows, "group string, field string, source string, row_id long, value string, preference long")
    assert {r.group: r.row_id for r in fuse(c).collect()} == {"g": 2, "h": 7}
    assert fuse(c.limit(0)).count() == 0


def test_copied_votes_count_less(spark):
    """Two sources that share the same wrong values elsewhere don't outvote two that err apart."""
    rows = []
    for n in range(12):  # three honest sources against copier and original, which agree on wrong values
        rows += [(f"g{n}", "f", s, 10 * n + k, "right", 1) for k, s in enumerate(("a", "b", "c"))] + [(f"g{n}", "f", s, 10 * n + 5 + k, "wrong", 1) for k, s in enumerate(("o", "p"))]
    rows += [("t", "f", "a", 900, "right", 1), ("t", "f", "b", 901, "right", 1), ("t", "f", "o", 902, "wrong", 1), ("t", "f", "p", 903, "wrong", 1)]
    c = spark.createDataFrame(rows, "group string, field string, source string, row_id long, value string, preference long")
    assert {r.group: r.row_id for r in fuse(c).collect()}["t"] == 900


def test_near_pairs_with_hot_values_in_blocks(spark, monkeypatch):
    """Every record has the same frequent words and lists are split from two records on; no pair is lost, and sizes differ."""
    from weftline.llm import near

    monkeypatch.setattr(near, "BLOCK_CLASS", 1)
    rng = random.Random(12)
    texts = []
    for k in range(40):
        base = VOCABULARY[:12] + [f"own{k}x{j}" for j in range(6)]
        texts += [base, base[:-2], base + ["more", f"more{k}"], VOCABULARY[: k % 12 + 1]]
    rows = [(i, " ".join(rng.sample(t, len(t))), "") for i, t in enumerate(texts)]
    membership, pairs = near.near_pairs(spark.createDataFrame(rows, "id long, title string, excerpt string"), "id", ["title", "excerpt"], 0.7)
    reps = sorted({r["class"] for r in membership.collect()})
    sets = {i: set(t) for i, t in enumerate(texts)}
    want = {(a, b) for n, a in enumerate(reps) for b in reps[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7 - 1e-9}
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 100


def test_a_set_has_one_row_in_each_of_its_lists(spark):
    """Rows of lists serve for finding and for looking, are not copied for lists of some ten thousand rows, and words of one record have none."""
    from weftline.llm import near

    sets = spark.range(20_000).select("id", F.array_sort(F.concat(F.array(*[F.lit(x << 40) for x in range(10)]), F.array(F.xxhash64("id")))).alias("w"))
    table = spark.sparkContext.broadcast(near.frequencies(sets, 26))
    rows = sets.mapInArrow(near.retained(0.7, table), "key long, id long, n int, place int, low long, high long")
    keep = 11 - 8 + 1  # of 11 words
    assert rows.count() <= 20_000 * keep


def test_lists_are_paired_as_one_by_one(monkeypatch):
    """Short and long stretches, sets of few and of many words, and batches that end within a list give the pairs that a loop over all pairs gives."""
    import pyarrow as pa

    from weftline.llm import near

    monkeypatch.setattr(near, "STEP", 100)
    monkeypatch.setattr(near, "PAIRS", 500)
    rng = np.random.default_rng(5)
    n, share = 900, 0.7 / 1.7
    key = np.sort(rng.choice([-7, 1, 2, 3, 1 << 60], n, p=[0.02, 0.1, 0.08, 0.7, 0.1]))
    size = rng.choice([6, 30, 34, 45, 90, 120], n)
    base = rng.integers(-(2**63), 2**63, (6, 2))
    bits = base[rng.integers(0, 6, n)]
    for _ in range(6):
        bits[np.arange(n), rng.integers(0, 2, n)] ^= np.int64(1) << rng.integers(0, 63, n)
    place = 2 * rng.integers(0, 1 + size * 3 // 10) + rng.integers(0, 2, n)
    ids = rng.permutation(n) + 10
    cols = [x[np.lexsort((ids, size, key))] for x in (key, ids, size.astype(np.int32), place.astype(np.int32), bits[:, 0], bits[:, 1])]
    batches = [pa.RecordBatch.from_arrays([pa.array(x[s : s + 40]) for x in cols], names=["key", "id", "n", "place", "low", "high"]) for s in range(0, n, 40)]
    rows = list(zip(*[x.tolist() for x in cols]))
    want = set()
    for f in rows:
        for a in rows:
            if f[0] == a[0] and f[3] & 1 and (f[2], f[1]) < (a[2], a[1]) and f[2] >= 0.7 * a[2] - 1e-9:
                need = share * (f[2] + a[2]) - 1e-9
                apart = sum(((f[k] ^ a[k]) & (2**64 - 1)).bit_count() for k in (4, 5))
                if min(f[2] - (f[3] >> 1), a[2] - (a[3] >> 1)) >= need and apart <= f[2] + a[2] - 2 * need:
                    want.add((min(f[1], a[1]), max(f[1], a[1])))
    for long in (1, 20, 10_000):
        for folded in (0, 22):
            monkeypatch.setattr(near, "LONG", long)
            monkeypatch.setattr(near, "FOLDED", folded)
            got = [p for b in near.meetings(0.7)(iter(batches)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            assert set(got) == want and len(want) > 1000


def test_fusion_overrules_a_preference_unless_votes_are_copied(spark):
    """With production weights: 150 sources that err apart overrule the preferred value of one; 150 that share false values elsewhere don't, unless copy detection is left out."""
    rows = []
    for k in range(150):
        rows.append(("honest", "f", f"h{k}", 1000 + k, "plain", 1))
        rows.append(("copied", "f", f"c{k}", 2000 + k, "plain", 1))
        rows += [(f"own{k}-{n}", "f", f"c{k}", 100_000 + 10 * k + n, "true", 1) for n in range(8)]
    rows += [("honest", "f", "lead", 1, "best", 2), ("copied", "f", "lead", 2, "best", 2)]
    for n in range(2):  # values that all of c claim and that are false, as the trusted sources and the preference say
        rows += [(f"g{n}", "f", f"c{k}", 10000 * (n + 1) + k, "wrong", 1) for k in range(150)] + [(f"g{n}", "f", f"t{k}", 10000 * (n + 1) + 500 + k, "right", 2) for k in range(160)]
    c = spark.createDataFrame(rows, "group string, field string, source string, row_id long, value string, preference long")
    with_it, without = ({r.group: r.row_id for r in fuse(c, copies=x).collect()} for x in (True, False))
    assert with_it["honest"] == without["honest"] == 1000
    assert with_it["copied"] == 2 and without["copied"] == 2000


def test_a_hot_group_is_kept_small(spark):
    """A group with nearly all rows, each with a value of its own."""
    rows = [("hot", "f", f"s{k % 7}", k, f"v{k}", k % 5000) for k in range(6000)] + [("cold", "f", "s1", 9999, "x", 0)]
    c = spark.createDataFrame(rows, "group string, field string, source string, row_id long, value string, preference long")
    assert {r.group: r.row_id for r in fuse(c).collect()} == {"hot": 4999, "cold": 9999}


def test_the_rule_holds_and_votes_decide_its_ties(spark):
    """150 sources don't overrule the latest moment; of two values that are equally good the one with more votes is taken, not the smallest id."""
    rows = [("late", "f", f"h{k}", 1000 + k, "plain", 1) for k in range(150)] + [("late", "f", "lead", 1, "best", 2)]
    rows += [("tie", "f", "a", 5, "x", 9), ("tie", "f", "b", 6, "y", 9), ("tie", "f", "c", 7, "y", 9), ("one", "f", "a", 8, "x", 3), ("one", "f", "b", 9, None, 4)]
    c = spark.createDataFrame(rows, "group string, field string, source string, row_id long, value string, preference long")
    assert {r.group: r.row_id for r in chosen(c).collect()} == {"late": 1, "tie": 6, "one": 8}
    assert {r.group: r.row_id for r in chosen(c.filter("group <> 'tie'")).collect()} == {"late": 1, "one": 8}
    assert chosen(c.limit(0)).count() == 0
