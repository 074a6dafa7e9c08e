"""Benchmark decontamination by greedy string tiling.

Benchmark items are cut into seeds of five successive words. Documents and
items that share a seed are aligned by greedy string tiling: at each search
length the unmarked windows of the item are looked up by their running
Karp-Rabin hashes among the unmarked windows of the document, matches are
extended as far as they go, and the longest non-overlapping ones are marked,
down to tiles of five words. An item's coverage is the share of its words in
tiles, so reordered or interrupted passages count as much as whole ones.

The benchmark is collected in blocks of bounded size; each block is broadcast
and all documents pass by it. Items are never split, so blocks are exact.

Defined results: null or word-less texts match nothing; items of fewer than
five words cannot be told from chance and match nothing; null and repeated ids
are carried; empty tables give empty results (or, for the filter, all
documents); other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.llm.common import gram_hash, in_slices, map_whole, prefix_hash, span_hash, table, word_spans

MIN_TILE, COVERAGE = 5, 0.6
#: Characters of benchmark text in one broadcast block at most (an item longer than that is a block of its own).
BLOCK_CHARS = 8 << 20
_FILTER_BITS = 20


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, words), longest first; of equal ones the first in the document, then in the item.

    ``doc`` and ``item`` are word hashes. No word of either lies in two tiles.
    """
    tiles: list[tuple[int, int, int]] = []
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    hash_doc, hash_item = prefix_hash(doc), prefix_hash(item)

    def open_windows(free: np.ndarray, size: int) -> np.ndarray:
        if len(free) < size:
            return np.zeros(0, np.int64)
        taken = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(taken[size:] == taken[:-size])

    size = max(least, len(item))
    while True:
        at_item, at_doc = open_windows(free_item, size), open_windows(free_doc, size)
        found: dict[tuple[int, int], int] = {}
        if len(at_item) and len(at_doc):
            seen: dict[int, list[int]] = {}
            for h, i in zip(span_hash(hash_item, at_item, at_item + size).tolist(), at_item.tolist(), strict=True):
                seen.setdefault(h, []).append(i)
            running = span_hash(hash_doc, at_doc, at_doc + size)
            near = np.isin(running, np.fromiter(seen, np.uint64, len(seen)))
            reached: dict[int, int] = {}  # diagonal -> first document place not yet covered by a match on it
            for h, d in zip(running[near].tolist(), at_doc[near].tolist(), strict=True):
                for i in seen[h]:
                    if d < reached.get(d - i, -1) or not np.array_equal(doc[d : d + size], item[i : i + size]):
                        continue
                    n = size
                    while d + n < len(doc) and i + n < len(item) and free_doc[d + n] and free_item[i + n] and doc[d + n] == item[i + n]:
                        n += 1
                    found[d, i] = n
                    reached[d - i] = d + n - size + 1
        queue = [(-n, d, i) for (d, i), n in found.items()]
        heapify(queue)
        while queue:
            n, d, i = heappop(queue)
            n = -n
            taken = np.flatnonzero(~(free_doc[d : d + n] & free_item[i : i + n]))
            if not len(taken):
                free_doc[d : d + n] = free_item[i : i + n] = False
                tiles.append((d, i, n))
                continue
            # what earlier tiles left of the match waits for its turn among the shorter ones
            for a, b in zip([0, *(taken + 1).tolist()], [*taken.tolist(), n], strict=True):
                if b - a >= size:
                    heappush(queue, (a - b, d + a, i + a))
        if size == least:
            return tiles
        size = max(least, size // 2)


@dataclass
class Index:
    """Sorted seed hashes of a benchmark block, with the items of each, and all items' words."""

    seeds: np.ndarray
    first: np.ndarray  # into items, one more than seeds
    items: np.ndarray
    ids: list
    words: list[np.ndarray]
    maybe: np.ndarray  # bitmap of the seeds' low bits


def build_index(ids: list, texts: list[str]) -> Index:
    _, h, row, _, _ = word_spans(texts)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    seeds, at = gram_hash(h, row, MIN_TILE)
    pairs = np.unique(np.stack([seeds, row[at].astype(np.uint64)], axis=1), axis=0) if len(seeds) else np.zeros((0, 2), np.uint64)
    unique, first = np.unique(pairs[:, 0], return_index=True)
    maybe = np.zeros(1 << _FILTER_BITS, bool)
    maybe[(unique & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
    return Index(unique, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64), ids, [h[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], maybe)


def _matches(texts: list[str], index: Index, coverage: float) -> list[list[tuple]]:
    """For each text the covered items: (item index, tiles, words in tiles, words of the item)."""
    out: list[list[tuple]] = [[] for _ in texts]
    _, h, row, _, _ = word_spans(texts)
    grams, at = gram_hash(h, row, MIN_TILE)
    near = np.flatnonzero(index.maybe[(grams & np.uint64(len(index.maybe) - 1)).astype(np.int64)]) if len(index.seeds) else np.zeros(0, np.int64)
    if not len(near):
        return out
    place = np.minimum(np.searchsorted(index.seeds, grams[near]), len(index.seeds) - 1)
    hit = index.seeds[place] == grams[near]
    near, place = near[hit], place[hit]
    doc_of = row[at[near]]
    for i in np.unique(doc_of).tolist():
        own = doc_of == i
        # every tile lies in words under shared seeds; what lies between becomes one break
        under = np.unique((at[near[own]][:, None] + np.arange(MIN_TILE)).ravel())
        gap = np.flatnonzero(np.diff(under) > 1) + 1
        words = np.insert(h[under], gap, np.uint64(0))
        wanted = np.unique(np.concatenate([index.items[index.first[p] : index.first[p + 1]] for p in np.unique(place[own])]))
        for k in wanted.tolist():
            tiles = greedy_tiles(words, index.words[k])
            covered = sum(n for _, _, n in tiles)
            if covered >= coverage * len(index.words[k]):
                out[i].append((k, len(tiles), covered, len(index.words[k])))
    return out


def blocks_of(benchmark: DataFrame) -> list[Index]:
    """Indexes over the whole benchmark, each collected within :data:`BLOCK_CHARS`."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS) or 1
    out = []
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        out.append(build_index([r.item_id for r in got], [r.text for r in got]))
    return out


HITS = "doc_id long, item_id long, n_tiles long, matched_words long, item_words long, coverage double"


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document and benchmark item of which it covers ``coverage`` or more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in blocks_of(benchmark):
        known = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, known=known) -> pa.RecordBatch | None:
            index = known.value
            found = _matches([t or "" for t in batch.column(1).to_pylist()], index, coverage)
            hits = [(d, index.ids[k], n, c, w, c / w) for d, items in zip(batch.column(0).to_pylist(), found, strict=True) for k, n, c, w in items]
            if not hits:
                return None
            kinds = [pa.int64()] * 5 + [pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*hits, strict=True), kinds, strict=True)], names=[x.split()[0] for x in HITS.split(", ")])

        part = rows.mapInArrow(in_slices(run), HITS)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that cover no benchmark item, with all their columns."""
    out = docs
    for index in blocks_of(benchmark):
        known = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, texts: list[str], known=known) -> pa.RecordBatch:
            return batch.filter(pa.array([not x for x in _matches(texts, known.value, coverage)], pa.bool_()))

        out = map_whole(out, run)
    return out


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
