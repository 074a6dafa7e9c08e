"""Best-fit-decreasing packing into fixed-length id matrices.

Each task tokenises its documents, cuts overlong ones losslessly at ``length``
and packs blocks of some million tokens: pieces in decreasing size go to the
open sequence with the least room that still holds them, found by a segment
tree over room sizes. Nothing is shuffled, and memory is bounded by the block.

Defined results: null text is empty and yields its end id alone; null ids and
repeated rows are packed like any others; an empty table gives an empty result;
only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.llm.common import slices, table
from coffer.llm.tokens import word_bpe_path, word_ids


class RoomTree:
    """Segment tree over room sizes 0..length, counting open bins of each size."""

    def __init__(self, length: int):
        self.leaves = 1 << (length + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += change
            node >>= 1

    def least(self, size: int) -> int:
        """The smallest room of an open bin that is at least ``size``; -1 if none."""
        node = size + self.leaves
        if self.count[node]:
            return size
        while node > 1:
            if node & 1 == 0 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Bins of piece indices; no bin exceeds ``length``. Equal sizes keep input order."""
    tree, by_room, bins, room = RoomTree(length), {}, [], []
    for piece in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        size = int(sizes[piece])
        found = tree.least(size)
        if found < 0:
            k = len(bins)
            bins.append([])
            room.append(length)
        else:
            k = by_room[found].pop()
            tree.add(found, -1)
        bins[k].append(piece)
        room[k] -= size
        tree.add(room[k], 1)
        by_room.setdefault(room[k], []).append(k)
    return bins


MATRIX = "shard int, row long, input_ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>"


def packed_matrices(docs: DataFrame, length: int = 4096, tokenizer: str | None = None, end_id: int = 49407, pad_id: int = 0, block_tokens: int = 8 << 20) -> DataFrame:
    """One row for each packed sequence.

    ``input_ids`` and ``position_ids`` are ``length`` little-endian unsigned
    16-bit numbers (the vocabulary and ``length`` stay below 65,536), positions
    start anew with each segment and are 0 in the padding; ``cu_seqlens`` are
    the segment bounds from 0 to ``n_tokens``; ``doc_ids`` and ``starts`` say
    which document each segment is from and where in it. (shard, row) is unique.
    """
    path = tokenizer or word_bpe_path()
    if not 0 < length <= 65536:
        raise ValueError("length must be within 1..65536")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, coder, made = TaskContext.get().partitionId(), word_ids(path), 0
        docs_, starts_, parts_, held = [], [], [], 0

        def emit() -> pa.RecordBatch:
            nonlocal made
            sizes = np.array([len(p) for p in parts_], np.int64)
            out = []
            for members in best_fit_decreasing(sizes, length):
                ids, positions = np.full(length, pad_id, "<u2"), np.zeros(length, "<u2")
                bounds = np.concatenate([[0], np.cumsum(sizes[members])])
                for k, m in enumerate(members):
                    ids[bounds[k] : bounds[k + 1]] = parts_[m]
                    positions[bounds[k] : bounds[k + 1]] = np.arange(sizes[m])
                out.append((shard, made, ids.tobytes(), int(bounds[-1]), bounds.tolist(), positions.tobytes(), [docs_[m] for m in members], [starts_[m] for m in members]))
                made += 1
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MATRIX.split(", ")])

        for batch in batches:
            size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0))
            for a, b in slices(size, 16 << 20):
                ids, offsets = coder.encode(batch.column(1).slice(a, b - a), end_id)
                for i, doc in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    own = ids[offsets[i] : offsets[i + 1]].astype("<u2")
                    for start in range(0, len(own), length):
                        docs_.append(doc)
                        starts_.append(start)
                        parts_.append(own[start : start + length])
                    held += len(own)
                if held >= block_tokens:
                    yield emit()
                    docs_, starts_, parts_, held = [], [], [], 0
        if parts_:
            yield emit()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, MATRIX)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_matrices(table(spark, sf_dir, "documents"))
