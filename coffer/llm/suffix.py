"""Suffix arrays, longest-previous-factor arrays, and exact repeats across documents.

A string of ``length`` bytes that starts at two places is found in three steps.

1. Every window of ``length`` bytes chooses an anchor inside it, the k-gram of
   least hash; equal windows choose equal anchors at equal offsets. Successive
   windows share anchors, so a document yields few anchor rows: the anchor's
   hash, and the hash of its context, the bytes of all windows that chose it.
2. Anchors that occur once are done. Where whole contexts occur more than once,
   all their windows repeat. One context of each kind goes on.
3. Different contexts of one anchor are compared in suffix order: previous and
   next smaller positions in the suffix array give each window's longest
   previous factor, next larger ones its longest next factor; a window repeats
   where either reaches ``length``. Buckets of anchors have bounded size. The
   contexts of an anchor that has very many are split first: its windows by
   their place around the anchor into two halves, each half by the bytes that
   all its windows share; equal parts of contexts again count as one, and so on
   until every group is small.

Defined results: null text is empty; texts shorter than ``length`` lose
nothing; repeated rows are copies of each other; null ids are carried; matches
never cross documents; an empty table gives an empty result; only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.llm.common import _TABLE, in_slices, materialize, mix, prefix_hash, slices, span_hash, table

ANCHOR = 40
#: Different contexts of one anchor that are compared in one task at most, and contexts of a bucket, about.
MOST_CONTEXTS, BUCKET_CONTEXTS = 1024, 2048


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of ``data`` (bytes) by prefix doubling, and the ranks by the first 1, 2, 4... values."""
    n = len(data)
    rank = data.astype(np.int64) + 1
    levels, width = [rank], 1
    order = np.argsort(rank, kind="stable")
    while width < n:
        shifted = np.zeros(n, np.int64)
        shifted[: n - width] = rank[width:]
        key = rank * (int(rank.max()) + 1) + shifted
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (np.diff(key[order]) != 0).astype(np.int64)]))
        levels.append(rank)
        width *= 2
        if rank.max() == n:
            break
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix in ``order`` with the one before it, by binary lifting over the ranks."""
    n = len(order)
    out = np.zeros(n, np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for k in range(len(levels) - 1, -1, -1):
        rank, step = levels[k], 1 << k
        inside = (a + step <= n) & (b + step <= n)
        equal = inside.copy()
        equal[inside] = rank[a[inside]] == rank[b[inside]]
        out[1:] += equal * step
        a, b = a + equal * step, b + equal * step
    return out


def previous_factors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lpf, source): for each place the longest match that starts earlier, and where (-1 if none).

    One pass over the suffix order with a stack: the previous and the next
    smaller position are the only candidates.
    """
    order, levels = suffix_array(np.frombuffer(data, np.uint8))
    lcp = common_prefixes(order, levels)
    n = len(order)
    lpf, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    stack: list[tuple[int, int]] = []  # (position, common prefix with the entry below)
    for i in range(n + 1):
        position, common = (int(order[i]), int(lcp[i])) if i < n else (-1, 0)
        while stack and stack[-1][0] > position:
            place, below = stack.pop()
            if max(below, common) > 0:
                lpf[place] = max(below, common)
                source[place] = stack[-1][0] if below >= common else position
            common = min(common, below)
        stack.append((position, common))
    return lpf, source


def window_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the suffix order of their ``length`` values, and whether each (from the second) equals the one before it.

    Values are 0..256. Ranks of seven values double until two of them cover a
    window.
    """
    n, width = len(data), min(7, length)
    padded = np.concatenate([data.astype(np.int64), np.zeros(width, np.int64)])
    key = padded[:n].copy()
    for k in range(1, width):
        key = key * 257 + padded[k : k + n]
    while True:
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (np.diff(key[order]) != 0).astype(np.int64)])) if n else order
        if 2 * width >= length:
            break
        key = rank * (n + 1)
        key[: n - width] += rank[width:]
        width *= 2
    # where the first ranks agree, the values up to the second rank do too
    key = rank[starts] * (n + 1) + rank[starts + length - width]
    order = np.argsort(key)
    return starts[order], np.diff(key[order]) == 0


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int, keep_first: bool) -> np.ndarray:
    """For each of ``starts`` whether its window's longest previous factor (or, unless ``keep_first``, next factor) among ``starts`` reaches ``length``.

    ``data`` holds separators below all else, which must not lie in a window.
    """
    order, same = window_order(data, starts, length)
    run = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    # within a run of equal windows, least positions so far from the left and from the right
    # are the previous and next smaller positions' answer to "is there an earlier match"
    far = len(data) + 1
    down = np.minimum.accumulate(order - run * far) + run * far
    up = np.minimum.accumulate((order + run * far)[::-1])[::-1] - run * far
    earlier = np.minimum(down, up) < order
    if keep_first:
        found = order[earlier]
    else:
        down = np.maximum.accumulate(order + run * far) - run * far
        up = np.maximum.accumulate((order - run * far)[::-1])[::-1] + run * far
        found = order[earlier | (np.maximum(down, up) > order)]
    hit = np.zeros(len(data), bool)
    hit[found] = True
    return hit[starts]


def anchor_runs(blobs: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(row, anchor place, first window, last window, anchor hash, context hash) of every anchor; places in the text."""
    sizes = np.array([len(b) for b in blobs], np.int64)
    data = np.frombuffer(b"".join(blobs), np.uint8)
    n_windows = np.maximum(sizes - length + 1, 0)
    if not n_windows.sum():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    prefix = prefix_hash(_TABLE[data])
    at = np.arange(len(data) - ANCHOR + 1)
    grams = mix(span_hash(prefix, at, at + ANCHOR))
    bits = np.uint64(len(grams).bit_length())
    least = (grams >> bits << bits) | at.astype(np.uint64)
    width, span = 1, length - ANCHOR + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    offset = np.cumsum(sizes) - sizes
    starts = np.repeat(offset - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(n_windows.sum())
    row = np.repeat(np.arange(len(blobs)), n_windows)
    chosen = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(chosen) != 0) | (np.diff(row) != 0)]))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    anchor, row = chosen[new], row[new]
    shape = ((anchor - first) * 1000003 + (last - anchor)).astype(np.uint64)
    context = mix(span_hash(prefix, first, last + length) + mix(shape))
    base = offset[row]
    return row, anchor - base, first - base, last - base, grams[anchor], context


def _texts(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), F.xxhash64(doc, text).alias("key"), text.alias("text"))


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, anchor, first, last, h, c = anchor_runs(_texts(batch.column(2)), length)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x.astype(np.int32)) for x in (first, last, anchor))],
            names=["h", "c", "doc_id", "key", "first", "last", "anchor"],
        )

    return rows.mapInArrow(in_slices(run), "h long, c long, doc_id long, key long, first int, last int, anchor int")


def _anchor_counts(rows: DataFrame, length: int) -> DataFrame:
    """(h) of the anchors that occur more than once; each slice is counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(0)), 0))
            for a, b in slices(sizes):
                h, n = np.unique(anchor_runs(_texts(batch.column(0).slice(a, b - a)), length)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], names=["h", "n"])

    counts = rows.select("text").mapInArrow(run, "h long, n byte")
    return counts.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def _compare(contexts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(key, start, end) removed bytes from contexts compared within their bucket."""

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks()
        rows = sorted(zip(batch["doc_id"].to_pylist(), batch["key"].to_pylist(), batch["first"].to_pylist(), batch["last"].to_pylist(), batch["n"].to_pylist(), batch["context"].to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0], r[1], r[2]))
        sizes = np.array([len(r[5]) + 1 for r in rows], np.int64)
        offset = np.cumsum(sizes) - sizes
        # bytes become 1..256 and 0 separates
        data = np.zeros(sizes.sum(), np.int64)
        inside = np.ones(len(data), bool)
        inside[offset + sizes - 1] = False
        data[inside] = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).astype(np.int64) + 1
        windows = sizes - length
        starts = np.repeat(offset - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        hit = repeated_windows(data, starts, length, keep_first)
        row = np.repeat(np.arange(len(rows)), windows)[hit]
        place = starts[hit] - offset[row]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(place) != 1)])) if len(row) else np.zeros(0, np.int64)
        end = np.append(new[1:], len(row)) - 1
        keys, firsts = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        a, b = firsts[row[new]] + place[new], firsts[row[new]] + place[end] + length
        return pa.table({"key": keys[row[new]], "start": a.astype(np.int32), "end": b.astype(np.int32)})

    return contexts.groupBy("bucket").applyInArrow(run, "key long, start int, end int")


PART = "h long, c long, n long, doc_id long, key long, first int, last int, anchor int, low int, high int, context binary"


def _halves(contexts: DataFrame, length: int) -> DataFrame:
    """Each context twice: the windows with the anchor in either half of their offsets, keyed by the bytes those all share."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r in batch.select(["h", "n", "doc_id", "key", "first", "last", "anchor", "low", "high", "context"]).to_pylist():
            mid = (r["low"] + r["high"] + 1) // 2
            for low, high in ((r["low"], mid - 1), (mid, r["high"])):
                # a window with the anchor at offset o starts o bytes before it
                first, last = max(r["first"], r["anchor"] - high), min(r["last"], r["anchor"] - low)
                if low > high or first > last:
                    continue
                text, base, anchor = r["context"], r["first"], r["anchor"] - r["first"]
                shared = text[anchor - low : anchor - high + length]
                part = text[first - base : last - base + length]
                h = xxhash.xxh3_64_intdigest(shared, r["h"] % 2**64 ^ low << 32 ^ high)
                c = xxhash.xxh3_64_intdigest(part, (r["anchor"] - first) << 16 ^ (last - first))
                out.append((h - (h >> 63 << 64), c - (c >> 63 << 64), r["n"], r["doc_id"], r["key"], first, last, r["anchor"], low, high, part))
        types = (*[pa.int64()] * 5, *[pa.int32()] * 5, pa.binary())
        names = [x.split()[0] for x in PART.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names) if out else None

    return contexts.mapInArrow(in_slices(run, "context"), PART)


def removed_spans(docs: DataFrame, length: int = 200, keep_first: bool = False) -> DataFrame:
    """(key, spans): byte spans of every document that lie in a repeated string; ``key`` as in :func:`_rows`.

    ``keep_first`` spares the first occurrence, in order of doc_id and place.
    """
    rows = _rows(docs)
    several = _anchor_counts(rows, length)
    found = materialize(_anchors(rows, length).join(several, "h", "left_semi"), "anchors")
    place = F.struct("doc_id", "key", "first", "last")
    # equal contexts have their anchor at one place after their first window
    whole = F.min(F.struct("doc_id", "key", "first", "last", "anchor"))
    kinds = found.groupBy("h", "c").agg(F.count("*").alias("n"), whole.alias("rep"))
    kinds = materialize(kinds.select("h", "c", "n", "rep.anchor", F.struct("rep.doc_id", "rep.key", "rep.first", "rep.last").alias("rep")), "contexts")

    def repeats(rows: DataFrame, classes: DataFrame) -> DataFrame:
        """Removed bytes of the rows whose whole part occurs more than once."""
        hit = rows.join(classes.where("n > 1").select("h", "c", "rep"), ["h", "c"])
        if keep_first:
            hit = hit.where(place != F.col("rep"))
        return hit.select("key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))

    def several_kinds(classes: DataFrame) -> DataFrame:
        """(h, kinds) of the anchors that have different contexts."""
        return classes.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")

    spans = repeats(found, kinds)
    reps = kinds.join(several_kinds(kinds), "h").select("h", "kinds", "n", "rep.doc_id", "rep.key", "rep.first", "rep.last", "anchor")
    asked = reps.groupBy("key").agg(F.collect_list(F.struct("h", "kinds", "n", "doc_id", "first", "last", "anchor")).alias("asked"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for key, text, wanted in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            out += [(w["h"], w["kinds"], w["n"], w["doc_id"], key, w["first"], w["last"], w["anchor"], text[w["first"] : w["last"] + length]) for w in wanted]
        types = (*[pa.int64()] * 5, *[pa.int32()] * 3, pa.binary())
        names = ["h", "kinds", "n", "doc_id", "key", "first", "last", "anchor", "context"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names) if out else None

    texts = rows.join(asked, "key").select("key", "text", "asked").mapInArrow(in_slices(cut), "h long, kinds long, n long, doc_id long, key long, first int, last int, anchor int, context binary")
    # repeated rows have one key and give one context
    contexts = texts.groupBy("h", "kinds", "n", "doc_id", "key", "first", "last", "anchor").agg(F.first("context").alias("context"))
    contexts = materialize(contexts.withColumn("low", F.lit(0)).withColumn("high", F.lit(length - ANCHOR)), "texts")
    while True:
        sizes = contexts.agg(F.count_if(F.col("kinds") <= MOST_CONTEXTS).alias("usual"), F.count_if(F.col("kinds") > MOST_CONTEXTS).alias("frequent")).first()
        buckets = -(-sizes.usual // BUCKET_CONTEXTS) or 1
        usual = contexts.where(F.col("kinds") <= MOST_CONTEXTS).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
        spans = spans.unionByName(_compare(usual, length, keep_first))
        if not sizes.frequent:
            break
        halves = materialize(_halves(contexts.where(F.col("kinds") > MOST_CONTEXTS), length), "halves")
        classes = materialize(halves.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(place).alias("rep")), "contexts")
        spans = spans.unionByName(repeats(halves, classes))
        kept = halves.join(classes.select("h", "c", "rep"), ["h", "c"]).where(place == F.col("rep"))
        contexts = materialize(kept.drop("c", "rep").join(several_kinds(classes), "h"), "texts")
    return spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 200, keep_first: bool = False, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` (binary) only ``with_text``."""
    spans = removed_spans(docs, length, keep_first)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, text, found in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            cuts = merged(found)
            edges = [0, *(x for cut in cuts for x in cut), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((doc, len(text), len(text) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = _rows(docs).join(spans, "key", "left").select("doc_id", "text", "spans")
    result = joined.mapInArrow(in_slices(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return result if with_text else result.drop("kept")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
