"""Quality by nearest-neighbour voting in a latent semantic space.

Terms of a text are its hashed byte trigrams, weighted by their document
frequencies over the whole corpus, and the bins of a few rates of its shape
(repeated words, repeated word pairs, capitals, marks, word lengths); a truncated singular value decomposition of a bounded labelled
sample gives the latent axes. The labelled vectors are broadcast, every
document's cosine with all of them is computed exactly in blocks, and its
nearest neighbours vote with their similarities.

Defined results: null and empty texts have no features and take the sample's
share of label 1 among featureless rows or, without such rows, the plain vote
of 0.5; with no usable labels every score is 0.5; labelled vectors that tie with
the last neighbour vote too, and repeated rows are scored alike; null ids count
as fold of the empty text; only doc_id and text are read; other columns pass
through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from coffer.llm.common import fold, gram_hash, in_slices, map_whole, slices, table, word_spans
from coffer.llm.labelled import sample_labels, with_labels

#: Labelled documents of each class in the space at most, hashed features, axes, voters.
PER_CLASS, FEATURES, AXES, NEIGHBOURS = 2000, 4096, 48, 25
#: A row costs dense counts of all features, so it weighs this much of a slice at least.
ROW_BYTES = 2 * FEATURES


def term_counts(texts: list[str]) -> np.ndarray:
    """(texts, FEATURES) counts of hashed byte trigrams; windows across two texts do not count."""
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(b) for b in blobs], np.int64)
    data = np.frombuffer(b"".join(blobs), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros((len(texts), FEATURES), np.float32)
    h = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA6B) + data[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - FEATURES.bit_length() + 1)
    row = np.repeat(np.arange(len(texts)), sizes)
    whole = row[:-2] == row[2:]
    index = row[:-2][whole] * FEATURES + h[whole]
    return np.bincount(index, minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES).astype(np.float32)


#: Bounds of the bins of each rate, and the weight of the shape terms against the trigrams.
BINS = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.92])
SHAPE_WEIGHT = 1.2
N_RATES = 8
SHAPE = N_RATES * (len(BINS) + 1)


def shape_rates(texts: list[str]) -> np.ndarray:
    """(texts, N_RATES) rates between 0 and 1."""
    n = len(texts)
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    row = np.repeat(np.arange(n), [len(b) for b in blobs])
    data = np.frombuffer(b"".join(blobs), np.uint8)

    def rate(hit: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, hit, minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)

    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    common = np.isin(data, np.frombuffer(b".,'-", np.uint8))
    mark = ~letter & ~space & ~common & ~((data >= 48) & (data <= 57))
    _, words, word_row, start, end = word_spans(texts)
    adjacent = np.concatenate([[False], (words[1:] == words[:-1]) & (word_row[1:] == word_row[:-1])]) if len(words) else np.zeros(0, bool)

    def repeated(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, of))
        again = np.concatenate([[False], (np.diff(of[order]) == 0) & (hashes[order][1:] == hashes[order][:-1])]) if len(order) else np.zeros(0, bool)
        return rate(again, of[order])

    pairs, at = gram_hash(words, word_row, 3)
    return np.stack([
        rate(adjacent, word_row), repeated(words, word_row), repeated(pairs, word_row[at]), rate(upper, row), rate(mark, row), rate(data == ord("|"), row),
        rate((data >= 48) & (data <= 57), row), np.minimum(rate((end - start).astype(float), word_row) / 16, 1),
    ], axis=1)


def shape_terms(texts: list[str]) -> np.ndarray:
    """(texts, SHAPE) of 0 and 1: the bin of each rate."""
    bins = np.searchsorted(BINS, shape_rates(texts), side="right") + np.arange(N_RATES) * (len(BINS) + 1)
    out = np.zeros((len(texts), SHAPE), np.float32)
    np.put_along_axis(out, bins, 1, axis=1)
    return out


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, over all rows; and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(0)), 0))
            for a, b in slices(np.maximum(sizes, ROW_BYTES)):
                total += (term_counts([t or "" for t in batch.column(0).slice(a, b - a).to_pylist()]) > 0).sum(axis=0)
                rows += b - a
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1, dtype=np.int32)), pa.array(np.append(total, rows))], names=["feature", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "feature int, n long")
    sums = {r.feature: r.n for r in found.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    return np.array([sums.get(i, 0) for i in range(FEATURES)], float), int(sums.get(FEATURES, 0))


@dataclass
class Space:
    axes: np.ndarray  # (terms, k)
    idf: np.ndarray
    vectors: np.ndarray  # (labelled, k), unit length
    labels: np.ndarray
    blank: float  # score of texts without features


def _weighted(counts: np.ndarray, shapes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = np.log1p(counts) * idf
    return np.hstack([w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9), shapes * np.float32(SHAPE_WEIGHT / np.sqrt(N_RATES))])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, per_class: int = PER_CLASS, seed: int = 3) -> Space | None:
    """The latent space of at most ``per_class`` labelled rows of each class."""
    frequency, n_docs = document_frequencies(docs)
    idf = (np.log((1 + n_docs) / (1 + frequency)) + 0.1).astype(np.float32)
    rows = with_labels(docs, sample_labels(labels, "quality", per_class, modulus, held_out))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        counts = np.hstack([term_counts(texts), shape_terms(texts)])
        sparse = [np.flatnonzero(c) for c in counts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([s.astype("<u2").tobytes() for s in sparse]), pa.array([c[s].astype("<f4").tobytes() for c, s in zip(counts, sparse, strict=True)])],
            names=["doc_id", "label", "at", "n"],
        )

    got = sorted(rows.mapInArrow(in_slices(run, row_bytes=ROW_BYTES), "doc_id long, label int, at binary, n binary").collect(), key=lambda r: (r.doc_id, r.label, r.at, r.n))
    if not got:
        return None
    x = np.zeros((len(got), FEATURES + SHAPE), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.at, "<u2")] = np.frombuffer(r.n, "<f4")
    y = np.array([r.label for r in got], np.float32)
    filled = x[:, :FEATURES].any(axis=1)
    blank = float(y[~filled].mean()) if (~filled).any() else 0.5
    x = _weighted(x[:, :FEATURES], x[:, FEATURES:], idf)
    rng, k = np.random.default_rng(seed), min(AXES, len(got))
    basis = np.linalg.qr(x.T @ (x @ rng.normal(size=(x.shape[1], k + 8)).astype(np.float32)))[0]
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ vt.T[:, :k]).astype(np.float32)
    return Space(axes, idf, _unit(x @ axes)[filled], y[filled], blank)


#: Cosines this near to each other are a tie; scores are rounded so that the same text scores alike beside any other rows.
TIE, DIGITS = 1e-6, 5


def votes(vectors: np.ndarray, space: Space, block: int = 1024) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors; exact cosines, blocked.

    All vectors that tie with the last neighbour vote.
    """
    k = min(NEIGHBOURS, len(space.labels))
    out = np.empty(len(vectors))
    for a in range(0, len(vectors), block):
        cosine = vectors[a : a + block] @ space.vectors.T
        last = np.partition(cosine, len(space.labels) - k, axis=1)[:, len(space.labels) - k, None]
        weight = np.where(cosine >= last - TIE, np.maximum(cosine, 1e-6) ** 4, 0)
        out[a : a + block] = (weight @ space.labels.astype(np.float64)) / weight.sum(axis=1, dtype=np.float64)
    return np.round(np.clip(out, 0, 1), DIGITS)


def score(docs: DataFrame, space: Space | None, into: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of the whole text as ``into``, which none of them may be called."""
    known = docs.sparkSession.sparkContext.broadcast(space)

    def run(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        s = known.value
        out = np.full(len(texts), 0.5 if s is None else s.blank)
        if s is not None and len(s.labels):
            counts = term_counts(texts)
            filled = counts.any(axis=1)
            if filled.any():
                out[filled] = votes(_unit(_weighted(counts[filled], shape_terms(texts)[filled], s.idf) @ s.axes), s)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, into])

    return map_whole(docs, run, StructField(into, DoubleType()), row_bytes=ROW_BYTES)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
