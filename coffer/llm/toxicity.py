"""Toxic passages as maximal scoring segments of token log-odds.

Tokens are words and word beginnings of 4 to 8 bytes, so that inflected forms of
one stem count together. Training counts them in labelled documents and, as a
Dirichlet prior, in the whole corpus; a word scores the largest log-odds of its
tokens that are significant for the toxic class, all other words a small
negative drift. A linear scan finds every maximal scoring segment of a whole
text. Extreme-value theory says that among ``n`` clean words a segment of score
``S`` or more turns up ``K * n * exp(-lambda * S)`` times, with lambda from the clean
background and K from the best segments of clean labelled rows by maximum
likelihood. A segment is significant if it is expected less than once; the
statistic of a text is the negative log-chance of its best ``r`` segments
together (the sum statistic of ordered segments), at the most telling ``r``, and 0
where nothing toxic is found. A logistic fit on the labelled sample maps its
logarithm to a probability; texts without a finding keep their own share of toxic rows.

Defined results: null, empty and word-less texts, and all texts in which nothing
toxic is found, have one score, the lowest, no passages, and prediction 0;
passages are code points of the text; repeated rows are scored alike; null ids
count as fold of the empty text; with no usable labels all scores are 0; only
doc_id and text are read, other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.llm.common import _TABLE, fold, in_slices, materialize, mix, prefix_hash, slices, span_hash, table, word_spans
from coffer.llm.labelled import sample_labels, with_labels

#: Labelled documents that a fit reads at most, of each class.
PER_CLASS = 8000
#: Parts of the sample for the calibration.
PARTS = 5
#: Lengths in bytes of the word beginnings that are tokens besides the word.
STEMS = (4, 5, 6, 7, 8)


@dataclass
class Lexicon:
    """Sorted word hashes with positive scores, drift, and calibration."""

    words: np.ndarray
    scores: np.ndarray
    drift: float
    lam: float
    k: float
    slope: float
    intercept: float
    none: float = 0.0  # the score of texts without a finding


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments in linear time.

    ``places`` are the indices of the positive items in increasing order and
    ``scores`` their values; every other item scores ``-drift``. Returns
    (first item, item after the last, score) in order.
    """
    left: list[float] = []
    right: list[float] = []
    first: list[int] = []
    last: list[int] = []
    link: list[int] = []
    gained = 0.0
    for n, (at, score) in enumerate(zip(places, scores, strict=True)):
        low = gained - drift * (at - n)
        gained += score
        high = gained - drift * (at - n)
        begin = at
        k = len(left) - 1
        while True:
            while k >= 0 and left[k] >= low:
                k = link[k]
            if k < 0 or right[k] >= high:
                break
            low, begin = left[k], first[k]
            del left[k:], right[k:], first[k:], last[k:]
            nearest = link[k]
            del link[k:]
            k = nearest
        left.append(low)
        right.append(high)
        first.append(begin)
        last.append(at)
        link.append(k)
    return [(a, b + 1, r - q) for a, b, q, r in zip(first, last, left, right, strict=True)]


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(bytes, row, start, end) of the words, and for each kind of token (word index, hash)."""
    data, h, row, start, end = word_spans(texts)
    prefix = prefix_hash(_TABLE[data])
    forms = [(np.arange(len(h)), h)]
    for n in STEMS:
        own = np.flatnonzero(end - start > n)
        forms.append((own, mix(span_hash(prefix, start[own], start[own] + n) + np.uint64(n * 0x9E3779B9))))
    return data, row, start, end, forms


class _Finder:
    """Looks tokens up in a sorted table; a bitmap of low bits answers most misses."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(table & np.uint64(len(self.maybe) - 1)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``h``, place in the table) of the tokens that are there."""
        near = np.flatnonzero(self.maybe[(h & np.uint64(len(self.maybe) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.table, h[near]), max(len(self.table) - 1, 0))
        hit = self.table[at] == h[near] if len(self.table) else np.zeros(len(near), bool)
        return near[hit], at[hit]


def _merge_counts(hashes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    words, inverse = np.unique(hashes, return_inverse=True)
    return words, np.bincount(inverse, weights, minlength=len(words)).astype(np.int64)


def _class_counts(sample: DataFrame) -> DataFrame:
    """(token hash, n1, n0): counts in toxic and in other documents of the labelled sample, as arrays with one number for each part."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, row, _, _, forms = tokens([t or "" for t in batch.column(1).to_pylist()])
        group = (np.asarray(batch.column(2)) * PARTS + np.asarray(batch.column(3)))[row]
        out = []
        for g in range(2 * PARTS):
            words, n = _merge_counts(np.concatenate([h[group[own] == g] for own, h in forms]))
            out.append((words.view(np.int64), np.full(len(words), g, np.int32), n))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["word", "part", "n"])

    counts = sample.select("doc_id", "text", "label", "part").mapInArrow(in_slices(run), "word long, part int, n long").groupBy("word")
    each = [F.coalesce(F.sum(F.when(F.col("part") == g, F.col("n"))), F.lit(0)) for g in range(2 * PARTS)]
    return counts.agg(F.array(*each[PARTS:]).alias("n1"), F.array(*each[:PARTS]).alias("n0"))


def _corpus_counts(docs: DataFrame, words: np.ndarray) -> dict[int, int]:
    """Tokens in the whole corpus of each given word, and under key None of all words."""
    known = docs.sparkSession.sparkContext.broadcast(np.sort(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = known.value
        find, total, counts = _Finder(lexicon), 0, np.zeros(len(lexicon), np.int64)
        for batch in batches:
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(0)), 0))
            for a, b in slices(sizes):
                for _, h in tokens([t or "" for t in batch.column(0).slice(a, b - a).to_pylist()])[4]:
                    total += len(h)
                    counts += np.bincount(find(h)[1], minlength=len(counts))
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([None, *lexicon[hit].view(np.int64).tolist()], pa.int64()), pa.array([total, *counts[hit].tolist()], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, n long")
    return {r.word: r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _background_lambda(scores: np.ndarray, rates: np.ndarray, drift: float) -> float:
    """The positive root of sum(p * exp(lambda * s)) = 1 for the clean background."""
    rest = max(1.0 - rates.sum(), 1e-9)

    def excess(lam: float) -> float:
        return float((rates * np.exp(lam * scores)).sum() + rest * np.exp(-lam * drift) - 1)

    low, high = 1e-6, 1e-6
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(low, 0.01)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted one-variable logistic fit by ridge Newton steps."""
    center, scale = float(np.average(x, weights=weight)), float(x.std() or 1.0)
    z, a, b = (x - center) / scale, 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(weight * (p - y) * z).sum() + 1e-2 * a, (weight * (p - y)).sum()])
        w = weight * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a / scale, b - a * center / scale


def _lexicon(words: np.ndarray, n1: np.ndarray, n0: np.ndarray, total1: float, total0: float, share: np.ndarray, min_z: float, drift: float, prior_share: float) -> Lexicon:
    """The tokens whose log-odds are significant, with the lambda of the clean background."""
    prior = prior_share * total0
    alpha = prior * share + 1e-3
    odds = np.log((n1 + alpha) / (total1 + prior - n1 - alpha)) - np.log((n0 + alpha) / (total0 + prior - n0 - alpha))
    z = odds / np.sqrt(1 / (n1 + alpha) + 1 / (n0 + alpha))
    kept = (z >= min_z) & (odds > 0)
    order = np.argsort(words[kept])
    model = Lexicon(words[kept][order], np.minimum(odds[kept][order], 6.0), drift, 1.0, 1.0, 0.0, -60.0)
    if kept.any():
        model.lam = _background_lambda(model.scores, (n0[kept] / total0)[order], drift)
    return model


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, per_class: int = PER_CLASS, min_z: float = 4.0, drift: float = 0.1, prior_share: float = 0.1) -> Lexicon:
    """Fit the lexicon and its calibration on labelled rows outside the held-out fold.

    The prior weighs ``prior_share`` of the other documents' tokens, spread as
    in the whole corpus. The calibration sees every labelled row by a lexicon
    that was counted without the row's part of the sample.
    """
    rows = with_labels(docs, sample_labels(labels, "toxic", per_class, modulus, held_out))
    rows = materialize(rows.withColumn("part", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(PARTS)).cast("int")), "labelled")
    counts = materialize(_class_counts(rows), "tokens")
    sums = counts.agg(*[F.sum(F.col(c)[g]).alias(f"{c}_{g}") for c in ("n1", "n0") for g in range(PARTS)]).first()
    totals = {c: np.array([sums[f"{c}_{g}"] or 0 for g in range(PARTS)], float) for c in ("n1", "n0")}
    total1, total0 = totals["n1"].sum(), totals["n0"].sum()
    empty = Lexicon(np.zeros(0, np.uint64), np.zeros(0), drift, 1.0, 1.0, 0.0, -60.0)
    if not total1 or not total0:
        return empty
    n1, n0 = (F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x) for c in ("n1", "n0"))
    # tokens of the bounded sample that occur five times at least, as arrays
    found = counts.where((n1 >= 5) & (n1 / F.lit(total1) > 2 * n0 / F.lit(total0))).toArrow().sort_by("word")
    words = found["word"].to_numpy().view(np.uint64)
    parts = {c: found[c].combine_chunks().flatten().to_numpy().astype(float).reshape(-1, PARTS) for c in ("n1", "n0")}
    corpus = _corpus_counts(docs, words)
    share = np.array([corpus.get(int(w), 0) for w in words.view(np.int64)], float) / max(corpus.get(None, 1), 1)

    def fitted(without: int | None) -> Lexicon:
        kept = [g for g in range(PARTS) if g != without]
        return _lexicon(words, parts["n1"][:, kept].sum(axis=1), parts["n0"][:, kept].sum(axis=1), totals["n1"][kept].sum(), totals["n0"][kept].sum(), share, min_z, drift, prior_share)

    model = fitted(None)
    if not len(model.words):
        return empty
    seen = []  # (label, words, scores of the segments, lambda) of every labelled row
    for g in range(PARTS):
        if totals["n1"].sum() > totals["n1"][g] and totals["n0"].sum() > totals["n0"][g]:
            other = fitted(g)
            got = _segments(rows.where(F.col("part") == g).select("label", "text"), other, keep="label").toArrow().to_pylist()
            seen += [(r["label"], r["n_words"], np.array([s["score"] for s in r["segments"]]), other.lam) for r in got]
    if not seen:
        return empty
    label, n_words, scores, lam = (list(c) for c in zip(*seen, strict=True))
    y, best = np.array(label, float), np.array([s.max(initial=0.0) for s in scores])
    clean = y == 0
    model.k = _background_k(best[clean], np.array(n_words)[clean], np.array(lam)[clean])
    x = np.array([text_statistic(s, n, v, model.k) for s, n, v in zip(scores, n_words, lam, strict=True)])
    # toxic rows weigh 0.4 of all, whatever their share of the sample: a little under even odds
    weight = np.where(y == 1, 0.4 / max(y.sum(), 1), 0.6 / max((1 - y).sum(), 1)) * len(y)
    told = x > 0
    if told.any():
        # by the logarithm, as long toxic texts have statistics of any size
        model.slope, model.intercept = _logistic(np.log1p(x[told]), y[told], weight[told])
    # texts without a finding take their own share of toxic rows, but never more than any finding would give
    share_none = float(weight[~told] @ y[~told] + 1e-3) / float(weight[~told].sum() + 2e-3)
    model.none = min(share_none, 1 / (1 + math.exp(-min(model.intercept, 60.0))))
    return model


def _background_k(best: np.ndarray, n_words: np.ndarray, lam: np.ndarray | float) -> float:
    """K by maximum likelihood from the best segments of clean texts; texts without a segment count as censored at 0."""
    exposure = float((n_words * np.exp(-lam * best)).sum())
    return max(float((best > 0).sum()), 0.5) / max(exposure, 1.0)


def text_statistic(scores: np.ndarray, n_words: int, lam: float, k: float) -> float:
    """Negative log-chance of the best segments of a text; 0 without any, and never below.

    One segment: ``1 - exp(-E)`` with ``E = K * n * exp(-lambda * S)``. The sum ``T`` of
    the best ``r`` normalised scores: ``exp(-T) * T**(r - 1) / (r! * (r - 1)!)``, times ``2**r``
    for the choice of ``r``.
    """
    if not len(scores):
        return 0.0
    normal = lam * np.sort(scores)[::-1] - math.log(k * max(n_words, 1))
    total = float(normal[0])
    # for rare segments the chance is the expectation itself
    out = total if total > 30 else -math.log(-math.expm1(-math.exp(min(-total, 30.0))))
    for r, value in enumerate(normal[1:].tolist(), 2):
        if value <= 0:
            break
        total += value
        out = max(out, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
    return max(out, 0.0)


SEGMENTS = "array<struct<start:int,end:int,score:double>>"


def _segments(docs: DataFrame, model: Lexicon, keep: str = "doc_id") -> DataFrame:
    """(keep, n_words, segments) of every row: all maximal scoring segments, in code points of the text."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = known.value
        texts = [t or "" for t in batch.column(1).to_pylist()]
        data, row, start, end, forms = tokens(texts)
        n_words = np.bincount(row, minlength=len(texts))
        segments: list[list[dict]] = [[] for _ in texts]
        if len(m.words) and len(row):
            find, worth = _Finder(m.words), np.zeros(len(row))
            for own, h in forms:
                near, at = find(h)
                worth[own[near]] = np.maximum(worth[own[near]], m.scores[at])
            # a word right after itself is the same evidence
            words = forms[0][1]
            worth[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])] = 0
            hit = np.flatnonzero(worth)
            first_word = np.concatenate([[0], np.cumsum(n_words)])
            rune = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            # texts are joined by single blanks, so each begins one place after the code points before it
            begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
            bounds = np.searchsorted(row[hit], np.arange(len(texts) + 1))
            for i in np.unique(row[hit]).tolist():
                own = hit[bounds[i] : bounds[i + 1]]
                for a, b, s in maximal_segments((own - first_word[i]).tolist(), worth[own].tolist(), m.drift):
                    w0, w1 = first_word[i] + a, first_word[i] + b - 1
                    segments[i].append({"start": int(rune[start[w0]] - begin[i]), "end": int(rune[end[w1]] - begin[i]), "score": float(s)})
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(segments, kind)], names=[keep, "n_words", "segments"])

    kind = dict(docs.dtypes)[keep]
    return docs.select(keep, "text").mapInArrow(in_slices(run), f"{keep} {kind}, n_words long, segments {SEGMENTS}")


def _statistics(docs: DataFrame, model: Lexicon, keep: str = "doc_id") -> DataFrame:
    """(keep, statistic, passages) of every row; passages are its significant segments, with their normalised scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found = np.asarray(batch.column(1)), batch.column(2)
            scores = found.flatten().field("score").to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(found)))])
            out = [text_statistic(scores[a:b], n, model.lam, model.k) for a, b, n in zip(bounds[:-1].tolist(), bounds[1:].tolist(), n_words.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), batch.column(1), found], names=[keep, "statistic", "n_words", "segments"])

    kind = dict(docs.dtypes)[keep]
    tested = _segments(docs, model, keep).mapInArrow(run, f"{keep} {kind}, statistic double, n_words long, segments {SEGMENTS}")
    rare = F.log(F.lit(model.k) * F.col("n_words"))
    normal = F.transform("segments", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), (F.lit(model.lam) * s.score - rare).alias("score")))
    return tested.select(keep, "statistic", F.filter(normal, lambda s: s.score > 0).alias("passages"))


def score(docs: DataFrame, model: Lexicon) -> DataFrame:
    """(doc_id, score, passages) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    line = F.lit(model.slope) * F.log1p("statistic") + F.lit(model.intercept)
    told = 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(60.0)), F.lit(-60.0))))
    return _statistics(rows, model).select("doc_id", F.when(F.col("statistic") > 0, told).otherwise(F.lit(model.none)).alias("score"), "passages")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "passages")
