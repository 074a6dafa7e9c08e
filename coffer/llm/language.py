"""Language identification by a byte convolutional network.

Texts are lower-cased UTF-8 bytes reduced to letter classes, cut into windows of
fixed length over the whole text. Filters of several widths slide over each
window, the largest response of each filter is kept, and a softmax layer gives
the languages; a text's score is the mean over its windows. A filter over
one-hot bytes is a sum of table rows, so the forward pass gathers rows of tables
indexed by byte pairs. The network is trained in numpy on the driver from a
bounded sample of pieces, drawn by hash from all places of all labelled texts;
every language is learnt, with fewer pieces of each where there are many.

Defined results: null text and text without any letter give ``und`` with score
0; null labels are not learnt; if nothing can be learnt, texts with letters
give ``und`` too; repeated rows are scored alike; an empty table gives an empty
result; only doc_id, text and, in training, lang are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coffer.llm.common import fold, in_slices, table

WINDOW = 128
#: Code points of a training piece; pieces in all, about, and of each language at most and at least.
PIECE, PIECES, MOST_EACH, LEAST_EACH = 256, 40_000, 2000, 50
WIDTHS, FILTERS = (2, 3, 4), 8

_WORDLY = re.compile(r"[^\W\d_]")
_CLASS = np.full(256, 1, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = np.arange(2, 28)
_CLASS[128:256] = np.arange(28, 156)
CLASSES = 156


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter; numerals such as fractions are none."""
    return any(m.group().isalpha() for m in _WORDLY.finditer(text))


def windows(texts: list[str], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(n, window) byte classes and the row of each window; the last window of a text is padded with blanks."""
    blobs = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(b) for b in blobs], np.int64)
    each = np.maximum(1, -(-sizes // window))
    joined = b"".join(b.ljust(n * window) for b, n in zip(blobs, each.tolist(), strict=True))
    return _CLASS[np.frombuffer(joined, np.uint8)].reshape(-1, window), np.repeat(np.arange(len(texts)), each)


@dataclass
class Network:
    languages: list[str]
    tables: dict[int, np.ndarray]  # width -> (width, CLASSES, FILTERS)
    bias: np.ndarray  # one for each filter
    dense: np.ndarray  # (filters, languages)
    dense_bias: np.ndarray

    def pair_tables(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """For each width: (offset, is a pair, table) terms."""
        out = []
        for width, t in self.tables.items():
            terms = [(j, True, (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(-1, t.shape[2])) for j in range(0, width - 1, 2)]
            out.append(terms + ([(width - 1, False, t[width - 1])] if width % 2 else []))
        return out


def _responses(x: np.ndarray, terms_by_width: list, widths: list[int]) -> list[np.ndarray]:
    pairs = x[:, :-1].astype(np.int32) * CLASSES + x[:, 1:]
    out = []
    for width, terms in zip(widths, terms_by_width, strict=True):
        places = x.shape[1] - width + 1
        total = None
        for offset, is_pair, t in terms:
            part = t[pairs[:, offset : offset + places] if is_pair else x[:, offset : offset + places]]
            total = part if total is None else np.add(total, part, out=total)
        out.append(total)
    return out


def probabilities(net: Network, x: np.ndarray, block: int = 512) -> np.ndarray:
    """Softmax of each window."""
    terms, widths = net.pair_tables(), list(net.tables)
    out = np.empty((len(x), len(net.languages)), np.float32)
    for a in range(0, len(x), block):
        pooled = np.concatenate([r.max(axis=1) for r in _responses(x[a : a + block], terms, widths)], axis=1)
        z = np.maximum(pooled + net.bias, 0) @ net.dense + net.dense_bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        out[a : a + block] = e / e.sum(axis=1, keepdims=True)
    return out


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network:
    """Train by Adam on the cross entropy; deterministic for given rows."""
    rng = np.random.default_rng(seed)
    n_filters = FILTERS * len(WIDTHS)
    p = {f"t{w}": rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS}
    p |= {"b": np.zeros(n_filters, np.float32), "d": rng.normal(0, 0.3, (n_filters, len(languages))).astype(np.float32), "c": np.zeros(len(languages), np.float32)}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            rows = order[a : a + batch]
            net = Network(languages, {w: p[f"t{w}"] for w in WIDTHS}, p["b"], p["d"], p["c"])
            responses = _responses(x[rows], net.pair_tables(), list(WIDTHS))
            best = [r.argmax(axis=1) for r in responses]
            pooled = np.concatenate([r.max(axis=1) for r in responses], axis=1) + p["b"]
            active = np.maximum(pooled, 0)
            z = active @ p["d"] + p["c"]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = e / e.sum(axis=1, keepdims=True)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            back = (g @ p["d"].T) * (pooled > 0)
            grads = {"d": active.T @ g, "c": g.sum(axis=0), "b": back.sum(axis=0)}
            for k, w in enumerate(WIDTHS):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                grad = np.zeros((w, CLASSES, FILTERS), np.float32)
                for j in range(w):
                    code = np.take_along_axis(x[rows], best[k] + j, axis=1)
                    np.add.at(grad[j], (code, np.arange(FILTERS)[None, :]), part)
                grads[f"t{w}"] = grad
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(languages, {w: p[f"t{w}"] for w in WIDTHS}, p["b"], p["d"], p["c"])


def train(docs: DataFrame, modulus: int = 3, held_out: int = 1, pieces: int = PIECES, seed: int = 7) -> Network | None:
    """Fit on about ``pieces`` pieces of labelled texts outside the held-out fold, alike many of each language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), modulus) != held_out))
    held = F.ceil(F.length("text") / PIECE)
    totals = {r.lang: int(r.n) for r in rows.groupBy("lang").agg(F.sum(F.greatest(held, F.lit(1))).alias("n")).collect()}  # one row for each language
    languages = sorted(totals)
    if not languages:
        return None
    each = max(LEAST_EACH, min(MOST_EACH, pieces // len(languages)))
    # a hash rate keeps a little over ``each`` pieces of every language; the exact bound follows by rank
    rate = rows.sparkSession.createDataFrame([(k, min(1.0, (1.2 * each + 40.0) / max(n, 1))) for k, n in totals.items()], "lang string, rate double")
    drawn = F.expr(f"filter(transform(sequence(0, greatest(0, cast(ceil(length(text) / {PIECE}) as int) - 1)), i -> struct(xxhash64(i, doc_id, digest) as draw, i as i)), x -> pmod(x.draw, {1 << 30}) < rate * {1 << 30})")
    own = rows.join(F.broadcast(rate), "lang").withColumn("digest", F.xxhash64("text"))
    picked = own.withColumn("p", F.explode(drawn)).select("lang", "p.draw", F.expr(f"substring(text, p.i * {PIECE} + 1, {PIECE})").alias("text"))
    ranked = picked.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(F.col("place") <= each)
    got = sorted((r.lang, r.text) for r in ranked.select("lang", "text").collect())
    x, row = windows([t for _, t in got])
    y = np.array([languages.index(k) for k, _ in got])[row]
    # a window with few letters teaches nothing
    useful = (x > 1).sum(axis=1) >= WINDOW // 4
    return fit(x[useful], y[useful], languages, seed=seed) if useful.any() else None


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from all windows of its whole text."""
    known = docs.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = known.value
        texts = [t or "" for t in batch.column(1).to_pylist()]
        lettered = np.array([has_letter(t) for t in texts], bool)
        names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
        if model is not None and lettered.any():
            own = np.flatnonzero(lettered)
            x, row = windows([texts[i] for i in own])
            weight = (x > 1).sum(axis=1).astype(np.float64) + 1e-3
            p = probabilities(model, x) * weight[:, None]
            first = np.searchsorted(row, np.arange(len(own)))
            mean = np.add.reduceat(p, first, axis=0) / np.add.reduceat(weight, first)[:, None]
            best = mean.argmax(axis=1)
            names[own] = np.array(model.languages, object)[best]
            scores[own] = np.clip(mean[np.arange(len(own)), best], 0, 1)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(in_slices(run), "doc_id long, lang_pred string, score double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
