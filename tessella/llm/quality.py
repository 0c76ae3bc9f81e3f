"""A quality classifier by nearest-neighbour voting.

Documents become latent-semantic vectors: counts of terms, of word shapes and of pairs of
shapes, log-weighted and projected on the leading singular vectors of a labelled sample.  The
labelled vectors are broadcast; every document is compared with all of them by exact
cosine products in blocks, and its nearest neighbours' labels are weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the classifier learns from at most; they are drawn by a hash of the id.
SAMPLE = 4096
SHAPES, PAIRS, TERMS = 2048, 2048, 2048
FEATURES, DIMENSIONS, NEIGHBOURS, BLOCK = SHAPES + PAIRS + TERMS, 48, 25, 256
#: The share of a vector's length that terms have.
TERM_WEIGHT = 0.5
#: Steps of a similarity; vectors whose similarities fall on one step are equally near.
STEPS = 100_000
HELD_OUT = 2  # the remainder of crc32(doc_id) mod 4 whose labels are never learnt

_SHAPE = str.maketrans({c: "a" for c in "abcdefghijklmnopqrstuvwxyz"} | {c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: "0" for c in "0123456789"})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def shape(word: str) -> str:
    """A word with its letters and digits made alike and runs shortened: "Thre***" is "Aa**"."""
    out: list[str] = []
    for c in word.translate(_SHAPE):
        c = c if c in "aA0" else "a" if c.islower() else "A" if c.isupper() else c
        if len(out) < 2 or not out[-1] == out[-2] == c:
            if c not in "aA0" or not out or out[-1] != c:
                out.append(c)
    return "".join(out[:12])


class Shapes(dict):
    """Word to the numbers of its shape and, behind all of these, of its term (A-Z lower-cased); remembers words until it is full."""

    def __missing__(self, word: str) -> int:
        import zlib

        if len(self) > 200_000:
            self.clear()
        term = zlib.crc32(word.encode().lower()) % TERMS
        n = self[word] = term * SHAPES + zlib.crc32(shape(word).encode()) % SHAPES
        return n


def features(text: str | None, shapes: Shapes) -> np.ndarray:
    """Log-weighted counts over the whole text, of unit length (zeros for no words)."""
    words = (text or "").split()
    out = np.zeros(FEATURES, np.float32)
    if not words:
        return out
    known = np.fromiter((shapes[w] for w in words), np.int64, len(words))
    ids = known % SHAPES
    out[:SHAPES] = np.bincount(ids, minlength=SHAPES)
    if len(words) > 1:
        same = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), bool, len(words) - 1)
        pairs = (ids[:-1] * 31 + ids[1:] * 7 + 1) % (PAIRS - 1) + 1
        pairs[same] = 0  # a word that repeats the one before
        out[SHAPES : SHAPES + PAIRS] = np.bincount(pairs, minlength=PAIRS)
    out[SHAPES + PAIRS :] = np.bincount(known // SHAPES, minlength=TERMS)
    out = np.log1p(out)
    for part, weight in ((out[: SHAPES + PAIRS], 1 - TERM_WEIGHT), (out[SHAPES + PAIRS :], TERM_WEIGHT)):
        part *= weight**0.5 / np.linalg.norm(part)
    return out


def _sample(docs: DataFrame, labels: DataFrame, label: str) -> tuple[np.ndarray, np.ndarray]:
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "label")
        .limit(SAMPLE)
    )

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in batches:
            rows = [features(t, shapes) for t in b.column(2).to_pylist()]
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.int64())), pa.array([r[i] for r, i in zip(rows, at, strict=True)], pa.list_(pa.float32()))], names=["doc_id", "label", "at", "value"])

    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.distinct()), "doc_id")
    met = met.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # of rows that repeat an id one text, so no more than the sample has
    rows = met.mapInArrow(vectors, "doc_id long, label double, at array<long>, value array<float>").toPandas()
    rows = rows.sort_values(["doc_id", "label"]).reset_index(drop=True)
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, (at, value) in enumerate(zip(rows["at"], rows["value"], strict=True)):
        x[i, at] = value
    return x, rows["label"].to_numpy(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(projection, unit vectors, labels) of the labelled sample."""
    x, y = _sample(docs, labels, label)
    if not len(x):
        return np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), y
    rank = min(DIMENSIONS, *x.shape)
    rng = np.random.default_rng(0)
    base, _ = np.linalg.qr(x.T @ rng.standard_normal((len(x), rank + 16)).astype(np.float32))
    for _ in range(3):
        base, _ = np.linalg.qr(x.T @ (x @ base))
    _, _, rows = np.linalg.svd(x @ base, full_matrices=False)
    projection = (base @ rows[:rank].T).astype(np.float32)
    return projection, _unit(x @ projection), y


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The similarity-weighted mean label of each vector's nearest neighbours.

    Similarities count in steps of 1 / ``STEPS``; of equally near ones the first known are taken.
    """
    if not len(known):
        return np.full(len(vectors), 0.5)
    near = np.rint(vectors @ known.T * STEPS)
    k = min(NEIGHBOURS, len(known))
    last = np.partition(near, len(known) - k, axis=1)[:, len(known) - k, None]
    chosen = near >= last
    for i in np.flatnonzero(chosen.sum(1) > k):  # ties for the last places
        tied = np.flatnonzero(near[i] == last[i])
        chosen[i, tied[k - int((near[i] > last[i]).sum()) :]] = False
    top = np.nonzero(chosen)[1].reshape(len(vectors), k)
    weight = (np.maximum(np.take_along_axis(near, top, 1), 0) / STEPS).astype(np.float64) ** 4
    total = weight.sum(1)
    prior = float(labels.mean())
    return np.where(total > 0, (weight * labels[top]).sum(1) / np.where(total > 0, total, 1), prior)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, label: str = "quality") -> DataFrame:
    """``docs`` with held_out, score (0 to 1, higher: label 1 likelier) and predicted (0 or 1).

    ``labels`` has doc_id and the label (0 or 1); rows with a null in either, and those
    held out, teach nothing.  A text without words (null, empty, blank) scores the share of
    label 1 in the sample; without any labels every score is 0.5.  Only the text counts, so
    rows that repeat a text score alike.  Of labelled rows that repeat an id the smallest text
    is learnt; of neighbours that are equally near those with the smallest ids vote.  Other columns are kept.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))
    fields = [f for f in docs.schema.fields if f.name not in ("held_out", "score", "predicted")]
    at = [f.name for f in fields].index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, known, y = model.value
        shapes = Shapes()
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                x = np.stack([features(t, shapes) for t in piece.column(at).to_pylist()])
                score = np.clip(vote(_unit(x @ projection), known, y), 0, 1)
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(fields)], pa.array(score, pa.float64())], names=[*(f.name for f in fields), "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    scored = docs.select(*[f.name for f in fields]).mapInArrow(judge, StructType([*fields, StructField("score", DoubleType())]))
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
