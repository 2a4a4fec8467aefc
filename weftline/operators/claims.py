"""Claims: sentences that state something, their groups, and which of them can't both hold.

Everything is a column expression or a join: sentences and their flags are made in one projection, groups come
from a prefix-filtered similarity join within stories, and who leads a group is settled in rounds over the pairs,
so no story is folded by one task."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.functions import text as T
from weftline.operators.dedup import resolve_in_order, token_pairs
from weftline.operators.materialize import materialize

MIN_TOKENS, MAX_TOKENS = 6, 60  # of a sentence that can be a claim
MAX_CLAIMS = 12  # of a text, the first ones
MAX_NAMES, CLAIM_NAMES = 24, 6  # entities of a text and of a claim, the most frequent ones
SAME_CLAIM = 0.55
SAME_FRAME = 0.45
SAME_ENTITIES = 0.5
NEGATED_TWIN = 0.75
TOKEN_SHARE = 0.75  # of a claim's similarity; the rest is that of its entities

# Words that name nothing, first the common ones, then days and months, then nouns of news.
NO_ENTITY = ["the", "a", "an", "of", "and", "or", "to", "in", "on", "for", "with", "as", "at", "by", "from", "is", "are", "was", "were", "be", "it", "its", "this", "that", "after", "over", "new", "says", "said", "will", "has", "have"]
NO_ENTITY_DATES = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "today", "yesterday", "tomorrow"]
NO_ENTITY_NOUNS = ["report", "reports", "review", "regulators", "researchers", "analysts", "sources", "developers", "company", "two", "three", "four", "five", "under", "what", "state", "officials", "construction", "pricing", "availability", "security"]
# Patterns of a run of capitalised words (a mark may stand where a sentence begins), of what may lead it, and of numbers.
NAME_RUN = "(?U)(\u0001?(?<!\\w)[A-Z][\\w&.'-]*(?:\\s+\u0001?(?:of|the|and|for)?\\s*[A-Z][\\w&.'-]*)*)"
NAME_LEAD = r"^(?:The|A|An|But|And|In|On|At|For|Of|To|As|After|Over)\s+"
NUMBER = r"\b(?:\$|€|£)?\d[\d,.]*\s?(?:%|percent|billion|million|trillion|bn|m)?\b"


@F.pandas_udf(StringType())
def normalize_unicode(s: pd.Series) -> pd.Series:
    """Compatibility form without control characters; null stays null. The one step that has no built-in."""
    t = s.str.normalize("NFKC")
    return t.map(lambda x: x if x is None or x.isprintable() else "".join(c for c in x if c in "\n\t" or unicodedata.category(c)[0] != "C"), na_action="ignore")


def entity_names(text: Column, limit: int = MAX_NAMES) -> Column:
    """Runs of capitalised words, most frequent first, then by name; a single word counts only if it stands inside a sentence somewhere."""

    def named(run: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.replace(run, F.lit("\u0001"), F.lit("")), NAME_LEAD, ""), r"^[ .,'\"-]+|[ .,'\"-]+$", "")
        return F.struct(F.regexp_replace(bare, "(?:'s|’s)$", "").alias("name"), run.startswith("\u0001").alias("first"))

    def kept(x: Column) -> Column:
        n = x["name"]
        return (F.length(n) >= 2) & ~F.lower(n).isin(NO_ENTITY + NO_ENTITY_DATES + NO_ENTITY_NOUNS) & ~((F.upper(n) == n) & n.rlike("(?U)\\p{Lu}") & (F.length(n) > 6))

    def ranked(found: Column) -> Column:
        real = F.filter(found, lambda x: x["name"].contains(" ") | F.exists(found, lambda y: (y["name"] == x["name"]) & ~y["first"]))
        names = F.array_distinct(F.transform(real, lambda x: x["name"]))
        counted = F.transform(names, lambda n: F.struct((-F.size(F.filter(real, lambda y: y["name"] == n))).alias("n"), n.alias("name")))
        return F.transform(F.slice(F.array_sort(counted), 1, limit), lambda x: x["name"])

    marked = F.regexp_replace(T.normalize_whitespace(text), r"(^|[.!?]\s)", "$1\u0001")
    return T.bound(F.filter(F.transform(F.regexp_extract_all(marked, F.lit(NAME_RUN), F.lit(1)), named), kept), ranked)


def _said(sentence: Column) -> Column:
    """struct(subject, predicate, object): around the first verb of attribution, else the first two words, the third and the rest."""

    def parts(w: Column) -> Column:
        bare = F.transform(w, lambda x: F.lower(F.regexp_replace(x, r"^[,.;:]+|[,.;:]+$", "")))
        verb = F.array_position(F.transform(bare, lambda x: x.isin(T.ATTRIBUTION)), True).cast("int")
        at = F.when(verb > 0, verb).otherwise(3)
        join = lambda x: F.nullif(F.regexp_replace(F.array_join(x, " "), r"^[ ,;:]+|[ ,;:]+$", ""), F.lit(""))
        word = F.when(verb > 0, F.get(bare, at - 1)).otherwise(F.lower(F.get(w, F.lit(2))))
        return F.struct(join(F.slice(w, F.lit(1), at - 1)).alias("subject"), word.alias("predicate"), join(F.slice(w, at + 1, F.size(w) + 1)).alias("object"))

    return T.bound(F.split(sentence, r"\s+"), parts)


def extract_claims(articles: DataFrame, text: str, limit: int = MAX_CLAIMS) -> DataFrame:
    """articles with a row per claim of the text column: sentences of 6 to 60 tokens that name or count something, attribute or date, the first limit ones
    of a text, with offsets into the clean text. Texts without claims (null, empty) give none. No shuffle."""

    def told(s: Column) -> Column:
        toks = T.tokens(s["s"])
        return F.struct(s["s"].alias("claim"), s["start"].cast("int").alias("start"), toks.alias("tokens"), F.size(F.array_intersect(toks, F.array(*[F.lit(x) for x in T.ATTRIBUTION]))).alias("said"), T.has_pattern(s["s"], T.DATE_HINT).alias("dated"), s["s"].rlike(NUMBER).alias("counted"), entity_names(s["s"], CLAIM_NAMES).alias("entities"))

    def placed(ss: Column) -> Column:
        starts = F.transform(ss, lambda x, i: F.aggregate(F.slice(ss, F.lit(1), i), F.lit(0), lambda n, y: n + F.length(y) + 1))
        return F.arrays_zip(ss.alias("s"), starts.alias("start"))

    df = articles.withColumn("_clean", T.normalize_whitespace(normalize_unicode(F.col(text))))
    sentences = T.bound(T.split_sentences(F.col("_clean")), lambda ss: F.transform(placed(ss), lambda z: F.struct(z["s"].alias("s"), z["start"].alias("start"))))
    fit = F.filter(sentences, lambda s: T.bound(F.size(T.tokens(s["s"])), lambda n: (n >= MIN_TOKENS) & (n <= MAX_TOKENS)))
    claims = F.filter(F.transform(fit, told), lambda c: (F.size(c["entities"]) > 0) | c["counted"] | (c["said"] > 0) | c["dated"])
    df = df.withColumn("_c", F.explode(F.slice(claims, 1, limit)))
    c = F.col("_c")
    norm = F.array_join(c["tokens"], " ")
    score = F.round(F.least(F.lit(1.0), 0.2 + 0.25 * (F.size(c["entities"]) > 0).cast("int") + 0.2 * c["counted"].cast("int") + 0.2 * (c["said"] > 0).cast("int") + 0.15 * c["dated"].cast("int")), 3)
    df = df.withColumn("_p", _said(c["claim"]))
    return df.select(
        *articles.columns, c["claim"].alias("claim"), c["start"].alias("start"), (c["start"] + F.length(c["claim"])).alias("stop"), norm.alias("normalized"), F.sha2(norm, 256).alias("claim_hash"), "_p.subject", "_p.predicate", "_p.object",
        score.alias("confidence"), c["entities"].alias("entities"), T.has_pattern(c["claim"], T.NEGATION).alias("negated"), T.has_pattern(c["claim"], T.HEDGE).alias("hedged"),
    )


def _sets(claims: DataFrame, story: str) -> DataFrame:
    """One row per claim of a story, equal ones collapsed: id, story, hash, tokens, names, frame (tokens without digits), quantities by unit, order of confidence."""
    top = F.max_by(F.struct("claim", "normalized", "confidence", "entities", "negated", "article_id"), F.struct("confidence", -F.col("article_id"))).alias("r")
    one = claims.groupBy(F.col(story).cast("string").alias("story"), "claim_hash").agg(top, F.max(~F.col("is_near_duplicate")).alias("own"))
    toks = F.array_distinct(F.split("r.normalized", " "))
    q = T.quantities(F.col("r.claim"))
    return one.select(
        F.concat_ws("/", "story", "claim_hash").alias("id"), "story", "claim_hash", F.col("r.claim").alias("claim"), "own", F.col("r.negated").alias("negated"), F.struct((-F.col("r.confidence")).alias("c"), F.col("r.article_id").alias("a")).alias("ord"),
        toks.alias("tokens"), F.filter(toks, lambda x: ~x.rlike("[0-9]")).alias("frame"), F.array_distinct(F.transform("r.entities", lambda e: F.lower(e))).alias("names"), q.alias("q"),
    )


def _alike(sets: DataFrame, tokens: str, threshold: float) -> DataFrame:
    """(a, b) of claims of one story whose tokens are similar: the story is part of each token, so lists never reach over stories."""
    return token_pairs(sets.select("id", F.transform(tokens, lambda w: F.concat_ws("|", "story", w)).alias("t")), "id", "t", threshold)


def _side(sets: DataFrame, n: str, *cols: str) -> DataFrame:
    return sets.select(F.col("id").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in cols])


def _grouping(claims: DataFrame, story: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, scored pairs, membership): membership is (id, head), the claim that leads the group: in order of confidence a claim leads unless an earlier leader
    is similar, and joins the most similar leader, the earlier of equals."""
    sets = materialize(_sets(claims, story), "claimsets")
    least = (SAME_CLAIM - (1 - TOKEN_SHARE)) / TOKEN_SHARE
    met = _alike(sets, "tokens", least).join(_side(sets, "a", "tokens", "names", "negated", "own"), "a").join(_side(sets, "b", "tokens", "names", "negated", "own"), "b")
    score = TOKEN_SHARE * T.jaccard(F.col("tokens_a"), F.col("tokens_b")) + (1 - TOKEN_SHARE) * T.jaccard(F.col("names_a"), F.col("names_b"))
    pairs = materialize(met.select("a", "b", score.alias("score"), "negated_a", "negated_b", "own_a", "own_b").filter(F.col("score") >= SAME_CLAIM), "claimpairs")
    led = resolve_in_order(sets.select("id", "ord"), pairs)
    heads = led.filter("id = original_id").select("id").join(sets.select("id", "ord"), "id")
    both = pairs.select("a", "b", "score").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    near = both.join(heads.select(F.col("id").alias("b"), F.col("ord").alias("ob")), "b").join(led.filter("id <> original_id").select(F.col("id").alias("a")), "a").join(sets.select(F.col("id").alias("a"), F.col("ord").alias("oa")), "a")
    near = near.filter(F.struct("ob", "b") < F.struct("oa", "a"))
    joined = near.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), "ob", "b")).alias("m")).select(F.col("a").alias("id"), F.col("m.b").alias("head"))
    return sets, pairs, materialize(heads.select("id", F.col("id").alias("head")).unionByName(joined), "claimgroups")


def _split(sets: DataFrame, pairs: DataFrame, member: DataFrame) -> DataFrame:
    """(head) of the groups whose own claims contradict each other: a claim gives other values for a unit than all before it, or one of two near claims is negated."""
    own = sets.filter("own").join(member, "id")
    rows = own.select("head", "ord", "id", F.explode("q").alias("v")).groupBy("head", F.col("v.unit").alias("unit"), "ord", "id").agg(F.collect_set("v.value").alias("values"))
    said = rows.groupBy("head", "unit").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "values"))).alias("l"))
    nothing = F.struct(F.array().cast("array<double>").alias("seen"), F.lit(False).alias("odd"))
    told = F.aggregate("l", nothing, lambda s, r: F.struct(F.array_union(s["seen"], r["values"]).alias("seen"), (s["odd"] | ((F.size(s["seen"]) > 0) & ~F.arrays_overlap(s["seen"], r["values"]))).alias("odd")))
    values = said.filter(told["odd"]).select("head")
    twins = pairs.filter("own_a AND own_b AND negated_a <> negated_b").filter(F.col("score") >= NEGATED_TWIN).join(member.select(F.col("id").alias("a"), "head"), "a").join(member.select(F.col("id").alias("b"), F.col("head").alias("_h")), "b").filter("head = _h").select("head")
    return values.unionByName(twins).distinct()


def claim_evidence(claims: DataFrame, story: str) -> DataFrame:
    """(article_id, story, claim_hash, disputes, confidence): each occurrence with the claim that leads its group; what is not negated in a group that contradicts itself disputes."""
    sets, pairs, member = _grouping(claims, story)
    heads = member.join(_split(sets, pairs, member).withColumn("_split", F.lit(True)), "head", "left").select("id", F.substring_index("head", "/", -1).alias("_head"), F.coalesce("_split", F.lit(False)).alias("_split"))
    c = claims.withColumn("id", F.concat_ws("/", F.col(story).cast("string"), "claim_hash"))
    return c.join(heads, "id").select("article_id", F.col(story).alias("story"), F.col("_head").alias("claim_hash"), (F.col("_split") & ~F.col("negated")).alias("disputes"), "confidence")


def claim_heads(claims: DataFrame, story: str) -> DataFrame:
    """claims with head, the hash of the claim that leads their group."""
    _, _, member = _grouping(claims, story)
    heads = member.select(F.col("id").alias("_id"), F.substring_index("head", "/", -1).alias("head"))
    return claims.withColumn("_id", F.concat_ws("/", F.col(story).cast("string"), "claim_hash")).join(heads, "_id").drop("_id")


def group_claims(claims: DataFrame, story: str) -> DataFrame:
    """(story, claim_hash, claim, occurrences, domains, duplicates, confidence, status) per group of claims of a story."""
    sets, pairs, member = _grouping(claims, story)
    c = claims.withColumn("id", F.concat_ws("/", F.col(story).cast("string"), "claim_hash")).join(member, "id")
    own = F.when(~F.col("is_near_duplicate"), F.col("source_domain"))
    agg = c.groupBy("head").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct(own).alias("domains"), F.count_if("is_near_duplicate").alias("duplicates"), F.max("confidence").alias("_c"), F.max("hedged").alias("_h"))
    split = _split(sets, pairs, member).withColumn("_split", F.lit(True))
    out = agg.join(split, "head", "left").join(sets.select(F.col("id").alias("head"), "story", "claim_hash", "claim"), "head")
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_c") + 0.1 * (F.col("domains") - 1) - 0.1 * F.col("_h").cast("int"))), 3)
    status = F.when(F.col("_split"), "unclear").when(F.col("domains") > 1, "repeated").otherwise("single_source")
    return out.select("story", "claim_hash", "claim", "occurrences", "domains", "duplicates", confidence.alias("confidence"), status.alias("status"))


def find_conflicts(claims: DataFrame, story: str) -> DataFrame:
    """(story, left_hash, right_hash, reason): leading claims of different groups of a story that can't both hold: one denies a value that the other asserts, or
    both give other values for one unit in one frame about the same names. The groups share a name and come from two sources at least."""
    sets, _, member = _grouping(claims, story)
    own = F.when(~F.col("is_near_duplicate"), F.col("source_domain"))
    c = claims.select(F.concat_ws("/", F.col(story).cast("string"), "claim_hash").alias("id"), own.alias("d"), F.transform("entities", lambda e: F.lower(e)).alias("e")).join(member, "id")
    of = c.groupBy("head").agg(F.collect_set("d").alias("domains"), F.array_distinct(F.flatten(F.collect_set("e"))).alias("all_names")).withColumnRenamed("head", "id")
    heads = materialize(sets.join(of, "id"), "heads")
    value = heads.select("id", "story", "negated", F.explode("q").alias("v"))
    denied = value.alias("l").join(value.alias("r"), (F.col("l.story") == F.col("r.story")) & (F.col("l.v") == F.col("r.v"))).filter("l.negated AND NOT r.negated").select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
    cols = ("story", "claim_hash", "ord", "tokens", "frame", "names", "negated", "q", "domains", "all_names")
    wide = lambda p: p.join(_side(heads, "a", *cols), "a").join(_side(heads, "b", *cols), "b")
    one = wide(denied).withColumn("reason", F.lit("denied_value"))
    unit = lambda n: F.array_distinct(F.transform(F.col(f"q_{n}"), lambda x: x["unit"]))
    of_unit = lambda n, u: F.filter(F.col(f"q_{n}"), lambda x: x["unit"] == u)
    other = F.exists(F.array_intersect(unit("a"), unit("b")), lambda u: ~F.arrays_overlap(of_unit("a", u), of_unit("b", u)))
    same = wide(_alike(heads, "frame", SAME_FRAME)).filter((T.jaccard(F.col("frame_a"), F.col("frame_b")) >= SAME_FRAME) & ~F.col("negated_a") & ~F.col("negated_b") & (T.jaccard(F.col("names_a"), F.col("names_b")) >= SAME_ENTITIES) & other)
    both = one.unionByName(same.withColumn("reason", F.lit("different_values_for_same_unit")))
    score = TOKEN_SHARE * T.jaccard(F.col("tokens_a"), F.col("tokens_b")) + (1 - TOKEN_SHARE) * T.jaccard(F.col("names_a"), F.col("names_b"))
    both = both.filter((score < SAME_CLAIM) & F.arrays_overlap("all_names_a", "all_names_b") & (F.size(F.array_union("domains_a", "domains_b")) >= 2))
    first = F.struct("ord_a", "a") < F.struct("ord_b", "b")
    return both.select(F.col("story_a").alias("story"), F.when(first, F.col("claim_hash_a")).otherwise(F.col("claim_hash_b")).alias("left_hash"), F.when(first, F.col("claim_hash_b")).otherwise(F.col("claim_hash_a")).alias("right_hash"), "reason").distinct()
