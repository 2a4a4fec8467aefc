import random

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.hashing import bands, simhash64
from weftline.functions.urls import canonicalize_url, extract_domain, normalize_language


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


def each(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


ADDRESSES = {
    "harbour.test/quay/7": "https://harbour.test/quay/7",
    "HTTP://WWW.Harbour.TEST/quay/7/": "https://harbour.test/quay/7",
    "https://harbour.test:443/quay/7#berths": "https://harbour.test/quay/7",
    "https://harbour.test/quay/7?gclid=q1&utm_campaign=spring": "https://harbour.test/quay/7",
    "https://harbour.test/quay?ship=corvo&berth=3&utm_medium=mail": "https://harbour.test/quay?berth=3&ship=corvo",
    "https://harbour.test": "https://harbour.test/",
    "": "",
    None: "",
}


def test_canonical_url(spark):
    assert each(spark, ADDRESSES, canonicalize_url) == list(ADDRESSES.values())


def test_domain(spark):
    hosts = {"https://pictures.harbour.co.uk/7": "harbour.co.uk", "https://corvo.substack.com/p/7": "corvo.substack.com", "http://quay.github.io/": "quay.github.io", "https://wordpress.com/tag/quay": "wordpress.com", "https://rss.corvo.wordpress.com/7": "corvo.wordpress.com", None: ""}
    assert each(spark, hosts, extract_domain) == list(hosts.values())


def test_language(spark):
    tags = {"Spanish": "spanish", "pt-BR": "pt", "de_AT": "de", None: "unknown", "": "unknown"}
    assert each(spark, tags, normalize_language) == list(tags.values())


def test_sentences(spark):
    assert each(spark, ["The quay is long. Is it deep? (It is.) \"Very,\" says Arn.", None, ""], T.split_sentences) == [["The quay is long.", "Is it deep?", "(It is.) \"Very,\" says Arn."], [], []]


def test_site_suffix(spark):
    head = "Halden Port opens a grain terminal for coastal ships"
    assert each(spark, [head + t for t in ("", " | Corvo Observer", " - The Evening Quay", " — Voice of the Coast", " · The Berth - Arn")], T.strip_site_suffix) == [head] * 5
    whole = ["Port keeps fees level - Verro hints at lower ones", "Quay beats its plan - cargo up 12%", "Tugs - Barges"]
    assert each(spark, whole, T.strip_site_suffix) == whole


def test_quantities(spark):
    got = one(spark, "The quay took 2,300 people and $1.5 billion", T.quantities)
    assert [(r.unit, r.value) for r in got] == [("billion", 1.5), ("jobs", 2300.0)]


def test_shingles_and_jaccard(spark):
    assert one(spark, "ab c", T.char_shingles) == ["abc"]
    assert one(spark, "abcde", T.char_shingles) == ["abcd", "bcde"]
    assert one(spark, "", T.char_shingles) == []
    r = spark.range(1).select(T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("x"), T.jaccard(F.array(F.lit("a")), F.array().cast("array<string>")).alias("y")).first()
    assert (r.x, r.y) == (0.5, 0.0)


def test_bands_survive_few_flips(spark):
    rng = random.Random(1)
    rows = []
    for flips in (0, 1, 3, 5, 7):
        for _ in range(40):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), flips):
                b ^= 1 << bit
            signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
            rows.append((signed(a), signed(b)))
    df = spark.createDataFrame(rows, "a long, b long").select(F.exists(F.zip_with(bands(F.col("a")), bands(F.col("b")), lambda x, y: x == y), lambda x: x).alias("ok"))
    assert df.filter(~F.col("ok")).count() == 0


def test_simhash_of_nothing_is_zero(spark):
    assert one(spark, "", lambda x: simhash64(T.tokens(x))) == 0
    assert one(spark, None, lambda x: simhash64(T.tokens(x))) == 0
