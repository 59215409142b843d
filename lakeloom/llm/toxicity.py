"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

r(g) = log((a + p(g)) / (a + p)) - log((a + q(g)) / (a + q)): p(g) and q(g) are the toxic and other labelled texts with
n-gram g, p and q all of them. A text's feature g is r(g) if the text has g, else 0; a logistic regression weighs them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ._common import pieces, sampled, written
from ._text import mix, randoms

_U = np.uint64
GRAMS = (4, 5, 6)
BUCKETS = 1 << 20
PIECE = 500_000  # bytes of text whose n-grams a task holds at once


def char_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams (GRAMS) of the lower-cased texts, and the text of each; each run of characters
    that are neither letters nor digits counts as one blank, and texts begin and end with one."""
    coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join([b"", *coded, b""]), np.uint8)
    ends = 1 + np.cumsum(np.fromiter((len(c) + 1 for c in coded), np.int64, len(coded)))
    sign = _SIGN[raw]
    keep = sign | np.concatenate([[True], sign[:-1]])
    text = np.searchsorted(ends, np.flatnonzero(keep), side="right")
    c = np.where(sign, raw, 32)[keep].astype(_U)
    found, owners = [], []
    hashes = np.zeros(len(c), _U)
    for i, r in enumerate(randoms(max(GRAMS), 41)):
        m = len(c) - i
        if m <= 0:
            break
        hashes = hashes[:m] + c[i:] * r
        if i + 1 in GRAMS:
            last = text[i:]
            whole = (text[1 : m + 1] == last) & ((text[:m] == last) | (c[:m] == 32))  # the blank before a text is that after another
            found.append((mix(hashes[whole] + _U(i)) % _U(BUCKETS)).astype(np.int64))
            owners.append(last[whole])
    return (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_SIGN = np.zeros(256, bool)
_SIGN[[*range(48, 58), *range(97, 123)]] = True
_SIGN[128:] = True


def _distinct(buckets: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(owner * BUCKETS + buckets)
    return key % BUCKETS, key // BUCKETS


class Model:
    """Weight of each chosen bucket, and the intercept. Of fixed size: at most `features` weights."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float):
        self.intercept = intercept
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[buckets] = np.arange(len(buckets))
        self.weights = weights

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chosen features of the texts, each once: place, text."""
        buckets, owner = char_grams(texts)
        place = self.place[buckets]
        hit = place >= 0
        return _distinct(place[hit].astype(np.int64), owner[hit])

    def score(self, texts: list[str]) -> np.ndarray:
        place, owner = self.features(texts)
        z = self.intercept + np.bincount(owner, weights=self.weights[place], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def learn_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", features: int = 4096, rows: int = 20_000, alpha: float = 1.0) -> Model:
    """Model from texts with a label (rows with a null label or id are left out; a null text is empty).

    About `rows` labelled rows are learned from, drawn row by row whatever their ids: that is the documented bound of the fit.
    An id with several labels has the more frequent one, 1 if both are; each row with that id has it. The `features` buckets
    whose counts differ most between the labels (chi-square) are kept. Without rows of both labels, every score is the smoothed share of
    label 1.
    """
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).cast("int").alias("label"))
    marked = named.groupBy("id").agg((2 * F.sum("label") >= F.count(F.lit(1))).cast("int").alias("label"))
    share = rows / max(1, docs.select(F.col(id_col).alias("id")).join(marked, "id").count())
    known = written(sampled(docs, share, "toxicity").select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marked, "id").select("id", "text", "label"))
    per_label = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    p, q = per_label.get(1, 0), per_label.get(0, 0)
    prior = float(np.log((p + 1) / (q + 1))) if p + q else float(np.log(1 / 9))
    if not p or not q:
        return Model(np.zeros(0, np.int64), np.zeros(0), prior)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_gram = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for block, texts in pieces(batch, 1, PIECE):
                label = block.column(2).to_numpy()
                buckets, owner = _distinct(*char_grams(texts))
                for y in (0, 1):
                    with_gram[y] += np.bincount(buckets[label[owner] == y], minlength=BUCKETS)
        used = np.flatnonzero(with_gram.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(with_gram[1, used]), pa.array(with_gram[0, used])], ["bucket", "p", "q"])

    both = F.col("p") + F.col("q")
    chi = (F.col("p") * float(q) - F.col("q") * float(p)) ** 2 / (both * (float(p + q) - both) + 1)
    best = (
        known.mapInArrow(count, "bucket long, p long, q long")
        .groupBy("bucket")
        .agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        .orderBy(chi.desc(), "bucket")
        .limit(features)
        .toArrow()
    )
    buckets = best["bucket"].to_numpy()
    ratio = np.log((alpha + best["p"].to_numpy()) / (alpha + p)) - np.log((alpha + best["q"].to_numpy()) / (alpha + q))
    chosen = Model(buckets, ratio, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(chosen)  # a fixed size

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for block, texts in pieces(batch, 1, PIECE):
                place, owner = model.features(texts)
                begins = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([block.column(2), pa.ListArray.from_arrays(begins, pa.array(place, pa.int32())), pa.ListArray.from_arrays(begins, pa.array(model.weights[place]))], ["label", "at", "value"])

    rows_in = written(known.mapInArrow(scaled, "label int, at array<int>, value array<double>"))
    to_vector = F.udf(lambda at, value: SparseVector(len(buckets), at, value), VectorUDT())
    fitted = LogisticRegression(regParam=1e-3, maxIter=40, standardization=False, labelCol="y", featuresCol="x").fit(
        rows_in.select(F.col("label").cast("double").alias("y"), to_vector("at", "value").alias("x"))
    )
    return Model(buckets, ratio * fitted.coefficients.toArray(), float(fitted.intercept))


def score_toxicity(docs: DataFrame, model: Model, keep: dict[str, Column], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Score of each whole text: the columns of `keep`, score (0 to 1), predicted (1 from the threshold on).

    One row for each input row; a null or empty text gets the score of a text without any chosen n-gram.
    """
    kept = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size

    names = list(keep)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in pieces(batch, len(names), PIECE):
                score = shared.value.score(texts)
                yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(scores, f"{fields}, score double, predicted int")


def toxicity_column(spark: SparkSession, model: Model, text_col: str) -> Column:
    """The score of a text column as a column expression, for filters: other columns stay in the JVM."""
    shared = spark.sparkContext.broadcast(model)  # a fixed size

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [shared.value.score(own) for _, own in pieces(batch, 0, PIECE)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.col(text_col))
