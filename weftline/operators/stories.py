"""Evolving stories: vectors of hashed features, online assignment, timeline with novelty, extractive summary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from weftline.functions import text as T
from weftline.operators.claims import entity_names
from weftline.operators.dedup import resolve_in_order, token_pairs
from weftline.operators.materialize import materialize

HOUR_US = 3_600_000_000
NOVELTY = 0.6
MAX_FEATURES = 64  # words and names of a story that are kept, the first by name
STATEMENT = 400  # letters of a statement in a summary


def feature_hashes(text: Column) -> Column:
    """Hashes of words, neighbouring words and runs of four letters over word ends."""
    def of(t: Column) -> Column:
        pairs = F.transform(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda b, i: F.xxhash64(F.get(t, i), b))
        runs = T.bound(F.array_join(t, ""), lambda x: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(x) - 3, F.lit(1))), lambda i: F.length(x) > 3), lambda i: F.xxhash64(F.substring(x, i, F.lit(4)), F.lit("run"))))
        return F.concat(F.transform(t, lambda w: F.xxhash64(w)), pairs, runs)

    return T.bound(T.tokens(text), of)


def hash_vectors(rows: DataFrame, text: str, dim: int = 256, out: str = "vector") -> DataFrame:
    """rows with a unit vector of the text: every feature's hash picks a place and a sign. Zeros for a null or empty text. One Arrow stage for the sums; other columns pass through."""

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            n = np.diff(np.asarray(lists.offsets))
            h = np.asarray(lists.flatten())
            m = np.zeros((batch.num_rows, dim))
            np.add.at(m, (np.repeat(np.arange(len(n)), n), (h.view(np.uint64) % np.uint64(dim)).astype(np.int64)), np.where(h >> 40 & 1, 1.0, -1.0))
            length = np.linalg.norm(m, axis=1, keepdims=True)
            flat = pa.array((m / np.where(length == 0, 1.0, length)).ravel())
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=[*batch.schema.names[:-1], out])

    schema = StructType([*rows.schema.fields, StructField(out, ArrayType(DoubleType()))])
    return rows.select("*", feature_hashes(F.col(text)).alias("_hashes")).mapInArrow(dense, schema)


class OpenStories:
    """Stories that an article may still join, as a matrix of centroids and columns beside it; what no later article reaches is dropped, so the state is bounded by
    the window. The score is the cosine plus weighted likeness of title words and names less a weight per day of distance; only stories whose
    cosine can reach the threshold are looked at further."""

    def __init__(self, threshold: float, window_hours: int, title_weight: float = 0.2, entity_weight: float = 0.1, time_weight: float = 0.0):
        self.threshold, self.window = threshold, window_hours * HOUR_US
        self.weights = title_weight, entity_weight, time_weight
        self.ids: list[int] = []
        self.words: list[set] = []
        self.names: list[set] = []
        self.topics: list[str | None] = []
        self.span = np.empty((0, 3), np.int64)  # first, last, articles
        self.centroids = np.empty((0, 0))
        self.of: dict[int, int] = {}  # stories of the articles that have duplicates to come

    def _drop(self, at: int) -> None:
        keep = np.flatnonzero(self.span[:, 1] >= at - 2 * self.window)
        if len(keep) < len(self.ids):
            self.ids, self.words, self.names, self.topics = ([x[i] for i in keep] for x in (self.ids, self.words, self.names, self.topics))
            self.span, self.centroids = self.span[keep], self.centroids[keep]

    def follow(self, story: int, at: int) -> None:
        """A duplicate counts in its original's story and widens its span; centroid and features stay."""
        if story in self.ids:
            i = self.ids.index(story)
            self.span[i] = min(self.span[i, 0], at), max(self.span[i, 1], at), self.span[i, 2] + 1

    def join(self, row_id: int, at: int, v: np.ndarray, words: set, names: set, topic: str | None) -> tuple[int, float, str]:
        self._drop(at)
        tw, ew, dw = self.weights
        best, top = -1, -1.0
        if self.ids:
            near = (self.span[:, 1] >= at - self.window) & (self.span[:, 0] <= at + self.window)
            if topic:
                near &= np.array([t is None or t == topic for t in self.topics])
            cos = self.centroids @ v
            for i in np.flatnonzero(near & (cos + tw + ew >= self.threshold)):
                day = max(0, at - self.span[i, 1], self.span[i, 0] - at) / (24 * HOUR_US)
                s = min(1.0, max(0.0, float(cos[i]) + tw * _like(words, self.words[i]) + ew * _like(names, self.names[i]) - dw * day))
                if s > top:
                    best, top = int(i), s
        if best < 0 or top < self.threshold:
            self.ids.append(row_id)
            self.words.append(set(sorted(words)[:MAX_FEATURES]))
            self.names.append(set(sorted(names)[:MAX_FEATURES]))
            self.topics.append(topic)
            self.span = np.vstack([self.span, [[at, at, 1]]])
            self.centroids = np.vstack([self.centroids.reshape(-1, len(v)), v])
            return row_id, 1.0, "new_story"
        first, last, n = self.span[best]
        c = self.centroids[best] + (v - self.centroids[best]) / (n + 1)
        length = np.linalg.norm(c)
        self.centroids[best] = c / length if length else c
        self.span[best] = min(first, at), max(last, at), n + 1
        self.words[best] = set(sorted(self.words[best] | words)[:MAX_FEATURES])
        self.names[best] = set(sorted(self.names[best] | names)[:MAX_FEATURES])
        return self.ids[best], top, "online"


def _like(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def originals(articles: DataFrame) -> DataFrame:
    """(id, root) of each duplicate that came after its original: the article at the end of the chain of duplicate_of, which is none itself. Pointers
    are doubled, so chains of any length end after the logarithm of it."""
    a = articles.select("id", "at", "is_near_duplicate", "duplicate_of").dropDuplicates(["id"])
    o = a.select(F.col("id").alias("duplicate_of"), F.col("at").alias("_at"))
    p = materialize(a.filter("is_near_duplicate").join(o, "duplicate_of").filter(F.struct("_at", "duplicate_of") < F.struct("at", "id")).select("id", F.col("duplicate_of").alias("root")), "originals")
    while True:
        q = materialize(p.join(p.select(F.col("id").alias("root"), F.col("root").alias("_up")), "root", "left").select("id", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "originals")
        p = q.select("id", "root")
        if q.filter("moved").isEmpty():
            return p


def assign_stories(articles: DataFrame, threshold: float = 0.5, window_hours: int = 72) -> DataFrame:
    """(id, story_id, similarity, method) from articles (id, title, body, at in microseconds, topic, is_near_duplicate, duplicate_of).

    The fold depends on order, so each topic is folded by one task, in order of (time, id); within a topic state is bounded by the window. A topic is
    cut in time where no article falls within the window, because no story reaches over such a gap: the key
    is (topic, stretch), and stretches come from one window function over the hours that have articles, not over the articles.
    A duplicate goes to the story of its original, whatever its own topic and however much later it came: it is folded where its original is.
    Vectors, words and names are made before the fold. Rows without time are left out; rows without topic share one."""
    a = articles.filter("at IS NOT NULL").withColumn("is_near_duplicate", F.coalesce("is_near_duplicate", F.lit(False)))
    roots = originals(a)
    a = a.withColumn("_topic", F.coalesce("topic", F.lit(""))).withColumn("_hour", F.floor(F.col("at") / HOUR_US))
    w = W.partitionBy("_topic").orderBy("_hour")
    hours = a.select("_topic", "_hour").distinct()
    cut = F.when(F.col("_hour") - F.lag("_hour").over(w) > window_hours + 1, 1).otherwise(0)
    stretches = hours.withColumn("_cut", cut).withColumn("_stretch", F.sum("_cut").over(w)).select("_topic", "_hour", "_stretch")
    place = a.join(stretches, ["_topic", "_hour"]).select(F.col("id").alias("root"), F.col("_topic").alias("_t"), F.col("_stretch").alias("_s")).dropDuplicates(["root"])
    a = a.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).join(place, "root")
    leads = roots.select(F.col("root").alias("id")).distinct().withColumn("_leads", F.lit(True))
    words = F.filter(T.token_set(F.col("title")), lambda x: ~x.isin(T.TITLE_STOP) & (F.length(x) > 2))
    names = F.array_distinct(F.transform(entity_names(F.col("body")), lambda x: F.lower(x)))
    keyed = hash_vectors(a, "body", out="_v").join(leads, "id", "left").select("_t", "_s", "id", "root", "at", "topic", "_v", words.alias("_w"), names.alias("_n"), F.coalesce("_leads", F.lit(False)).alias("_leads"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        stories = OpenStories(threshold, window_hours)
        out = []
        for r in pdf.sort_values(["at", "id"]).itertuples(index=False):
            if r.root != r.id and r.root in stories.of:
                stories.follow(stories.of[r.root], r.at)
                out.append((r.id, stories.of[r.root], 1.0, "duplicate_link"))
                continue
            told = stories.join(r.id, r.at, np.asarray(r[6]), set(r[7]), set(r[8]), r.topic if isinstance(r.topic, str) else None)
            if r[9]:
                stories.of[r.id] = told[0]
            out.append((r.id, *told))
        return pd.DataFrame(out, columns=["id", "story_id", "similarity", "method"])

    return keyed.groupBy("_t", "_s").applyInPandas(fold, "id long, story_id long, similarity double, method string")


def fresh_sentences(members: DataFrame) -> DataFrame:
    """(story, id, pos, sentence, new) of the sentences of articles that are no duplicates, from (story, id, at, is_near_duplicate, body).

    A sentence is new with four tokens or more and a similarity below NOVELTY to all new ones before it in the story. Sentences of equal
    words are one before any pairing; the rest are paired by rare tokens within their story, and who is new is settled in rounds over the pairs."""
    s = members.filter(~F.col("is_near_duplicate")).select("story", "id", "at", F.posexplode(T.split_sentences(F.col("body"))).alias("pos", "sentence"))
    s = materialize(s.withColumn("_t", T.token_set(F.col("sentence"))).withColumn("_k", F.sha2(F.array_join(F.array_sort("_t"), " "), 256)), "sentences")
    order = F.struct(F.col("at").isNull().alias("n"), "at", F.col("id").alias("i"), "pos")
    reps = s.filter(F.size("_t") >= 4).groupBy("story", "_k").agg(F.min(order).alias("ord"), F.first("_t").alias("_t"))
    reps = materialize(reps.select(F.concat_ws("/", "story", "_k").alias("id"), "ord", F.transform("_t", lambda x: F.concat_ws("|", "story", x)).alias("t"), "story", "_k"), "reps")
    met = token_pairs(reps, "id", "t", NOVELTY).join(reps.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(reps.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    near = materialize(met.filter(T.jaccard(F.col("ta"), F.col("tb")) >= NOVELTY).select("a", "b"), "near")
    new = resolve_in_order(reps.select("id", "ord"), near).filter("id = original_id").select("id").join(reps, "id").select("story", F.col("ord.i").alias("id"), F.col("ord.pos").alias("pos"), F.lit(True).alias("new"))
    return s.join(new, ["story", "id", "pos"], "left").select("story", "id", "pos", "sentence", F.coalesce("new", F.lit(False)).alias("new"))


def timeline(members: DataFrame) -> DataFrame:
    """(story, id, position, is_first_report, new_sentences, repeated_sentences) from (story, id, at, is_near_duplicate, body). Duplicates add no sentences. Times missing come last."""
    told = fresh_sentences(members).groupBy("story", "id").agg(F.count_if("new").alias("_new"), F.count_if(~F.col("new")).alias("_old"))
    w = W.partitionBy("story").orderBy(F.col("at").asc_nulls_last(), "is_near_duplicate", "id")
    lead = ~F.col("is_near_duplicate") & (F.count_if(~F.col("is_near_duplicate")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1)
    out = members.select("story", "id", F.row_number().over(w).alias("position"), lead.alias("is_first_report")).join(told, ["story", "id"], "left")
    return out.select("story", "id", "position", "is_first_report", F.coalesce("_new", F.lit(0)).cast("int").alias("new_sentences"), F.coalesce("_old", F.lit(0)).cast("int").alias("repeated_sentences"))


def summarize(members: DataFrame, per_section: int = 5, per_article: int = 2) -> DataFrame:
    """(story, position, statement, evidence_id, article_id): the newest articles' first new sentences, at most per_section a story; new ones differ from
    each other by NOVELTY already. Every statement cites the article it is quoted from."""
    new = fresh_sentences(members).filter("new").join(members.select("story", "id", "at"), ["story", "id"])
    first = new.withColumn("_n", F.row_number().over(W.partitionBy("story", "id").orderBy("pos"))).filter(F.col("_n") <= per_article)
    top = first.withColumn("position", F.row_number().over(W.partitionBy("story").orderBy(F.col("at").desc_nulls_first(), F.col("id").desc(), "pos"))).filter(F.col("position") <= per_section)
    return top.select("story", "position", F.substring("sentence", 1, STATEMENT).alias("statement"), evidence_id(F.col("id"), F.col("sentence")).alias("evidence_id"), F.col("id").alias("article_id"))


def evidence_id(article: Column, sentence: Column) -> Column:
    return F.concat(F.lit("ev-"), article.cast("string"), F.lit("-"), F.substring(F.sha2(sentence, 256), 1, 8))
