"""Toxicity severity by cumulative-link ordinal regression over sparse word features."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.store import saved

#: Bounds of the training sample: labelled documents, words kept as features; least evidence (G-test) and documents of a feature.
MAX_LABELLED, MAX_FEATURES, MIN_EVIDENCE, MIN_DOCS = 8000, 2000, 24.0, 4
PENALTY, STEPS, RATE = 0.0002, 600, 0.2
#: Lengths of word beginnings that are features besides the words themselves.
PREFIXES = (3, 4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
_OUT = "doc_id long, severity double, grade int, p_toxic double, toxic boolean"


def features(text: str | None) -> set[str]:
    """Lower-cased words, each with a closing blank, and their beginnings."""
    words = set(WORD.findall((text or "").lower()))
    found = {w + " " for w in words}
    for n in PREFIXES:
        found.update([w[:n] for w in words if len(w) > n])
    return found


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [sorted(features(t)) for t in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])


def sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, toxic, words``: the labelled documents with the smallest hashes of their id.

    At most ``limit`` labels, so their list is small enough to go to every task.  A
    document labelled twice is toxic if any label says so; null ids and labels are left out.
    """
    usable = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.max("toxic").cast("int").alias("toxic"))
              .withColumn("place", F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 53))))
    # by hash about four times as many as wanted, so that ranking them is small work for any number of labels
    share = usable.agg(F.lit(4.0 * limit) * (1 << 53) / F.greatest(F.count("*"), F.lit(1))).scalar()
    chosen = usable.where(F.col("place") < share).orderBy("place", "doc_id").limit(limit).drop("place")
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
                 .mapInArrow(_words, "doc_id long, toxic int, words array<string>"))


def vocabulary(labelled: DataFrame) -> list[tuple[str, int]]:
    """Words whose presence goes with the label, with its direction; at most ``MAX_FEATURES``."""
    totals = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, t = float(totals["n"]), float(totals["t"])
    if not t or t == n:
        return []
    counts = labelled.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("d"), F.sum("toxic").alias("a"))
    cell = lambda seen, row, column: F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)
    d, a = F.col("d").cast("double"), F.col("a").cast("double")
    evidence = 2 * (cell(a, d, t) + cell(d - a, d, n - t) + cell(t - a, n - d, t) + cell(n - d - t + a, n - d, n - t))
    found = (counts.where(F.col("d") >= MIN_DOCS).where(F.col("d") < n).select("word", evidence.alias("g"), F.when(a * n > d * t, 1).otherwise(-1).alias("sign"))
             .where(F.col("g") >= MIN_EVIDENCE).orderBy(F.desc("g"), "word").limit(MAX_FEATURES))
    return [(r["word"], r["sign"]) for r in found.collect()]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """P(grade <= k) = sigmoid(threshold[k] - w . x): one weight a word, shared by ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade, one row a document."""
        below = np.c_[_sigmoid(self.thresholds[None, :] - scores[:, None]), np.ones(len(scores))]
        return np.diff(below, axis=1, prepend=0.0)

    def score(self, text: str | None) -> float:
        known = self.weights
        return sum(known[w] for w in sorted(features(text) & known.keys()))


def fit(rows: list[list[int]], grades: np.ndarray, n_features: int, n_grades: int, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of greatest penalised likelihood, by adaptive gradient steps."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([f for r in rows for f in r], dtype=np.int64)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / len(grades), 0.01, 0.99)
    start = np.log(share / (1 - share))
    # thresholds rise because their distances are exponentials
    p = np.r_[np.zeros(n_features), start[0], np.log(np.maximum(np.diff(start), 0.1))]
    square = np.zeros_like(p)
    mean = np.zeros_like(p)
    n, cuts = len(grades), n_grades - 1
    for step in range(1, STEPS + 1):
        w, steps_up = p[:n_features], np.exp(p[n_features + 1:])
        thresholds = p[n_features] + np.r_[0.0, np.cumsum(steps_up)]
        score = np.bincount(doc, weights=w[feature], minlength=n)
        padded = np.r_[-40.0, thresholds, 40.0]
        high, low = _sigmoid(padded[grades + 1] - score), _sigmoid(padded[grades] - score)
        chance = np.maximum(high - low, 1e-9)
        up = np.where(grades < cuts, high * (1 - high), 0.0) / chance
        down = np.where(grades > 0, low * (1 - low), 0.0) / chance
        of_cut = np.bincount(grades, weights=-up, minlength=n_grades)[:cuts] + np.bincount(grades, weights=down, minlength=n_grades)[1:]
        g = np.r_[np.bincount(feature, weights=(up - down)[doc], minlength=n_features) / n + penalty * w,
                  of_cut.sum() / n, np.cumsum(of_cut[::-1])[::-1][1:] * steps_up / n]
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        p = p - RATE * (1 - step / STEPS) * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return p[:n_features], p[n_features] + np.r_[0.0, np.cumsum(np.exp(p[n_features + 1:]))]


def train(docs: DataFrame, labels: DataFrame) -> OrdinalModel:
    """Grade 0 is not toxic; toxic documents are grade 1 or 2 by how many of their words speak for the label.

    The labels say only toxic or not; of toxic documents those with more than the
    median number of such words are severe.
    """
    labelled = sample(docs, labels)
    words = vocabulary(labelled)
    if not words:
        return OrdinalModel({}, np.array([40.0, 41.0]))
    number = {w: i for i, (w, _) in enumerate(words)}
    speaks = np.array([s > 0 for _, s in words])
    known = labelled.sparkSession.createDataFrame([(w, i) for w, i in number.items()], "word string, feature int")
    seen = (labelled.select("doc_id", "toxic", F.explode_outer("words").alias("word")).join(F.broadcast(known), "word", "left")
            .groupBy("doc_id", "toxic").agg(F.collect_list("feature").alias("features")).orderBy("doc_id", "toxic").collect())
    rows = [sorted(r["features"]) for r in seen]
    toxic = np.array([r["toxic"] > 0 for r in seen])
    evidence = np.array([int(speaks[r].sum()) if r else 0 for r in rows])
    grades = np.where(toxic, np.where(evidence > max(1.0, np.median(evidence[toxic])), 2, 1), 0)
    weights, thresholds = fit(rows, grades, len(words), 3)
    return OrdinalModel({w: float(weights[i]) for w, i in number.items()}, thresholds)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, severity, grade, p_toxic, toxic`` of every document, by its whole text.

    ``severity`` is the expected grade (0 to 2), ``grade`` the likeliest one, ``toxic``
    whether a grade above 0 is likelier than not.  Null and empty texts have no words
    and get the severity of a text without evidence; without usable labels every
    severity is 0; repeated rows are scored alike.
    """
    model = train(docs.select("doc_id", "text"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chances = model.grades(np.array([model.score(t) for t in batch.column(1).to_pylist()], dtype=np.float64))
            p_toxic = 1 - chances[:, 0]
            yield pa.record_batch([batch.column(0), pa.array(chances @ np.arange(chances.shape[1])), pa.array(chances.argmax(axis=1).astype(np.int32)),
                                   pa.array(p_toxic), pa.array(p_toxic > 0.5)], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)
