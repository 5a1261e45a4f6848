"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each feature is a word, its first letters, a pair of neighbours or a pair with
one word between them, hashed to a fixed number of weights and either present
or absent. First letters (of inflected words) make endings matter less. Every
weight has its own learning rate, and the L1 term keeps all but a few at zero,
so what is broadcast is a short list of (feature, weight).

Training reads a bounded sample: at most ``MAX_TRAIN`` labelled rows, those with
the smallest hashes of their ids, in the order of these hashes. So the model
doesn't depend on how rows are stored. Their features are made on the
executors; one task fits the weights.

Defined results
* A null or empty text gets the score of no feature: the bias alone.
* Null labels are left out; an id with several labels counts as toxic if one of them is.
* A null id counts as the empty text in the hold-out rule; it never matches a label.
* Rows that repeat an id are scored row by row. Without labels every score is the prior given.
* An empty table gives an empty result. Inputs of a score are the words alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import narrowed, without
from tidepanel.llm.substring_dedup import mixed

DIMENSIONS = 1 << 20
MAX_TRAIN = 6144
FOLDS = 5
# FTRL-proximal: learning rate, its smoothing, L1 and L2 terms, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 4.0, 0.0, 5
STEMS = (4, 7)
CACHED_WORDS = 100_000
_WORD = re.compile(r"\w+")
_BIAS = DIMENSIONS


class WordIds(dict):
    """64-bit hashes of lower-case words, or of their first letters; the usual words stay cached."""

    def __init__(self, letters: int | None = None):
        super().__init__()
        self.letters = letters

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word[: self.letters].encode("utf-8", "replace"), self.letters or 0)
        return h


def lookups() -> list[WordIds]:
    return [WordIds(), *(WordIds(n) for n in STEMS)]


def features(text: str, ids: list[WordIds]) -> np.ndarray:
    """Hashed features, repeats included."""
    words = _WORD.findall(text.lower())
    x, *stems = (np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) for known in ids)
    next_, over = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    pairs, skips = mixed(x[:-1] * next_ + x[1:]), mixed(x[:-2] * over + x[2:])
    return (np.concatenate((x, *stems, pairs, skips)) & np.uint64(DIMENSIONS - 1)).astype(np.int64)


def sigmoid(z: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def fit(examples: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) that are not zero, after passes of FTRL-proximal over the examples in order; each has the bias too."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi, ni = z[i], n[i]
        l1 = np.where(i == _BIAS, 0.0, L1)
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for found, y in examples:
            # Put together here, so that the sample is held once.
            i = np.append(found, _BIAS)
            w = weights(i)
            g = sigmoid(w.sum()) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    i = np.flatnonzero(z)
    w = weights(i)
    return i[w != 0], w[w != 0]


def _fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        order, label, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        rows += [(o, y, found[k].values.to_numpy()) for k, (o, y) in enumerate(zip(order, label, strict=True))]
    rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
    i, w = fit([(f, y) for _, y, f in rows])
    yield pa.record_batch([pa.array(i, pa.int64()), pa.array(w, pa.float64())], names=["feature", "weight"])


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN
) -> list[tuple[int, float]]:
    """The model as (feature, weight) pairs, from labels whose id is not held out."""
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    sample = known.withColumn("o", F.xxhash64("id")).orderBy("o", "id").limit(max_train)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = lookups()
        for batch in batches:
            found = [np.unique(features(t.as_py(), ids)).astype(np.int32) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["o", "y", "found"])

    texts = narrowed(docs, id_col, text_col)
    # At most max_train rows of 24 bytes.
    rows = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("o", "y", "text")
    made = rows.mapInArrow(hashed, "o bigint, y int, found array<int>")
    made = made.groupBy("o").agg(F.min(F.struct("y", "found")).alias("r")).select("o", "r.y", "r.found")
    model = made.repartition(1).mapInArrow(_fit_sample, "feature bigint, weight double").collect()
    return [(r["feature"], r["weight"]) for r in model]


def score(docs: DataFrame, model: list[tuple[int, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, score) for each row; h is the text's hash. The model is as short as its weights that are not zero."""
    spark = docs.sparkSession
    found = np.array([i for i, _ in model if i != _BIAS], np.int64)
    values = np.array([w for i, w in model if i != _BIAS], np.float64)
    bias = float(sum(w for i, w in model if i == _BIAS))
    sent = spark.sparkContext.broadcast((found, values, bias))
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.binary()), ("score", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, start = sent.value
        dense = np.zeros(DIMENSIONS, np.float64)
        dense[keys] = weights
        ids = lookups()
        for batch in batches:
            out = []
            for text in batch.column(2):
                f = features(text.as_py(), ids)
                f = np.unique(f[dense[f] != 0])
                out.append(float(sigmoid(start + dense[f].sum())))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.float64())], schema=schema)

    texts = narrowed(docs, id_col, text_col).select("doc_id", F.unhex(F.md5("text")).alias("h"), "text")
    return texts.mapInArrow(scored, "doc_id bigint, h binary, score double")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more."""
    bad = score(docs, train(docs, labels, id_col, text_col), id_col, text_col).filter("score >= 0.5").select("doc_id", "h").distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return without(docs, [F.col(id_col).cast("bigint"), F.unhex(F.md5(text))], bad)
