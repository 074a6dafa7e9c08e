"""SimHash near-duplicates by segment popcounts.

Fingerprints are 64-bit majority votes of XXH64 shingle hashes. A fingerprint
is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance
of two embeddings is a lower bound of the Hamming distance of the fingerprints,
so a range join under it misses no link. The join runs on a grid over
the counts: the segments form groups; within ``distance`` at least
``groups - distance`` whole groups agree in all their counts, and the total
count of the others differs by ``distance`` at most. A cell is a choice of
agreeing groups, their counts, and the total of the others in steps of
``distance + 1``; a pair meets in equal or adjoining cells. The Manhattan
distance then drops most pairs of a cell, and ``bit_count(a ^ b)`` decides.
Links become components by alternating large-star and small-star rounds, each
written to the shared folder.

Defined results: null or empty text, or text without words, has fingerprint 0
and links like any other; repeated rows each keep their row; rows with a null
``doc_id`` keep a fingerprint and take the smallest non-null id of their
component (null if there is none); an empty table gives an empty result; only
``doc_id`` and ``text`` are read, other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coffer.llm.common import _TABLE, columns_of, drop_table, fresh, gram_hash, in_slices, materialize, mix, prefix_hash, span_hash, spread_join, standing, table

#: Sketches of a text for copies that differ in more than a few places, and shingles in each.
SKETCHES, SKETCH_SHINGLES = 12, 4
#: Bins of the signature that estimates a similarity, the least estimate that is verified, and members compared exactly in one task at most.
BINS, ESTIMATE, MEMBERS = 128, 0.65, 4096
#: Rows of a group that are spanned in one task, about, and the rows of a larger group that all its tasks have in common.
BLOCK, PIVOTS = 512, 16
#: Shingles of the texts compared in one task at most.
SHINGLES = 4_000_000


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the hashes of ``width``-word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(norm[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), 8192):
        part = h[a : a + 8192].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(in_slices(run), "doc_id long, fp long")


#: Bits of a segment, and a word with the low bit of every segment set.
SEGMENT, LOW = 2, 0x5555555555555555


def embedded(fp: str) -> str:
    """SQL of the segment counts of a long, in unary (0 is 00, 1 is 01, 2 is 11): Manhattan distance is the number of differing bits."""
    either, both = f"(({fp} | shiftrightunsigned({fp}, 1)) & {LOW}L)", f"({fp} & shiftrightunsigned({fp}, 1) & {LOW}L)"
    return f"({either} | shiftleft({both}, 1))"


def _masks(groups: int, agreeing: int) -> list[int]:
    """For each choice of ``agreeing`` groups the mask of their segments, as signed longs."""
    edges = [SEGMENT * round(64 // SEGMENT * i / groups) for i in range(groups + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    values = [sum(parts[i] for i in chosen) for chosen in combinations(range(groups), agreeing)]
    return [v - (1 << 64) if v >= 1 << 63 else v for v in values]


def groups_for(count: int) -> int:
    """Groups of segments for so many fingerprints: more groups make narrower cells and more copies of each row."""
    return 5 if count < 1 << 24 else 6 if count < 1 << 27 else 7


def candidates(fps: DataFrame, distance: int = 3, groups: int = 5, bound: bool = True) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that meet in a cell, each once; with ``bound`` those of Manhattan distance up to ``distance``."""
    if groups <= distance:
        raise ValueError("groups must exceed distance")
    masks = _masks(groups, groups - distance)
    step = distance + 1
    counts = fps.select("fp").distinct().withColumn("counts", F.expr(embedded("fp")))
    keyed = counts.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("counts").bitwiseAND(F.lit(m)).alias("agreed"), F.expr(f"cast(bit_count(counts & {~m}L) as int)").alias("rest"))
        for i, m in enumerate(masks)
    ])).alias("t")).select("fp", "t.choice", "t.agreed", "t.rest")
    cell = F.floor(F.col("rest") / step).cast("int")
    upper = keyed.select(F.col("fp").alias("b"), "choice", "agreed", F.col("rest").alias("b_rest"), cell.alias("cell"))
    lower = keyed.select(F.col("fp").alias("a"), "choice", "agreed", F.col("rest").alias("a_rest"), F.explode(F.array_distinct(F.array(cell, F.floor((F.col("rest") + distance) / step).cast("int")))).alias("cell"))
    ordered = (F.col("b_rest") - F.col("a_rest")).between(0, distance) & ((F.col("a_rest") < F.col("b_rest")) | (F.col("a") < F.col("b")))
    met = lower.join(upper, ["choice", "agreed", "cell"]).where(ordered)
    differ = f"({embedded('a')} ^ {embedded('b')})"
    if bound:
        met = met.where(F.expr(f"bit_count({differ})") <= distance)
    #: a pair that agrees under several choices is kept under the first of them
    first = F.expr("case " + " ".join(f"when ({differ} & {m}L) = 0 then {i}" for i, m in enumerate(masks)) + " else -1 end")
    return met.where(F.col("choice") == first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(fps: DataFrame, distance: int = 3, groups: int | None = None) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints with at most ``distance`` differing bits, each once."""
    if groups is None:
        groups = groups_for(fps.select("fp").distinct().count())
    return candidates(fps, distance, groups).where(F.expr("bit_count(a ^ b)") <= distance)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of undirected edges (a, b) of longs; root is the smallest node reachable.

    Alternating large-star and small-star rounds; the minimum of a node's
    neighbours is a partial aggregate and goes back to its edges by a join, so
    that no node's neighbours are gathered in one task.
    """
    pairs = edges.select("a", "b").where("a <> b").distinct()
    pairs = materialize(pairs, "edges")
    state = None
    for _ in range(max_rounds):
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every edge points from the larger node u to the smaller v
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        hooked = small.select(F.col("u").alias("b"), F.col("m").alias("a")).unionByName(
            small.where("v <> m").select(F.col("v").alias("b"), F.col("m").alias("a"))
        )
        done, pairs = pairs, materialize(hooked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        drop_table(done)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    stars = pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, groups: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    rows = materialize(fingerprints(docs, width), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    roots = components(links(prints, distance, groups))
    named = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "roots")
    sizes = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    labels = spread_join(named.select("fp", "root", F.col("n").alias("rows")), sizes, "root").select("fp", "component_id", F.col("rows").alias("n"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return spread_join(rows, labels, "fp").select("doc_id", hexed, "component_id")


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    prefix = prefix_hash(_TABLE[np.frombuffer(b"".join(words), np.uint8)])
    hashes = mix(span_hash(prefix, np.concatenate([[0], ends[:-1]]), ends))
    return np.unique(gram_hash(hashes, np.zeros(len(hashes), np.int64), min(width, len(hashes)))[0])


def _majority(h: np.ndarray) -> int:
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) * 2 > len(h)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def sketches(own: np.ndarray) -> list[int]:
    """SimHash fingerprints of small samples of a shingle set: for each salt those with the least salted hashes.

    Two texts of similarity J draw one whole sample alike with a chance of
    about ``J ** SKETCH_SHINGLES``, and meet in one of ``SKETCHES`` almost surely
    from 0.8 on.
    """
    if not len(own):
        return []
    out = []
    for salt in range(1, SKETCHES + 1):
        h = mix(own ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64))
        least = np.sort(np.partition(h, SKETCH_SHINGLES)[:SKETCH_SHINGLES] if len(h) > SKETCH_SHINGLES else h)
        out.append(_majority(mix(least + np.uint64(salt))) ^ salt)
    return out


def _similar(rows: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least ``similarity``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            u, v = shingle_set(x, width), shingle_set(y, width)
            both = len(np.intersect1d(u, v, assume_unique=True))
            keep.append(both >= similarity * (len(u) + len(v) - both))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = standing(rows, "row", pairs.select(F.explode(F.array("a", "b")).alias("row")))
    left = pairs.join(rows.select(F.col("row").alias("b"), F.col("text").alias("text")), "b")
    both = left.join(rows.select(F.col("row").alias("a"), F.col("text").alias("other")), "a")
    return both.select("a", "b", "text", "other").mapInArrow(in_slices(run), "a long, b long")


def signature(shingles: np.ndarray) -> bytes:
    """One-permutation MinHash: the 16 low bits of the least hash in each of ``BINS`` bins, 0 for an empty bin."""
    h = np.sort(mix(shingles))  # by bin, as the high bits choose it, then by hash
    where = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.concatenate([[True], np.diff(where) != 0])[: len(h)]
    out = np.zeros(BINS, "<u2")
    out[where[first]] = np.maximum(h[first] & np.uint64(0xFFFF), 1)
    return out.tobytes()


def spanning_pairs(rows: np.ndarray, signatures: np.ndarray, forests: int = 2) -> list[tuple[int, int]]:
    """Pairs of rows that hold a group together at any similarity: edge-disjoint maximum spanning forests.

    ``signatures`` is (rows, BINS). A pair's weight is the share of bins filled
    in either text that agree; pairs below ``ESTIMATE`` do not count. A maximum
    spanning forest keeps the connections that all pairs above a threshold
    would make; the second one makes up for most errors of the estimate, and
    ``unsettled_pairs`` for the rest.
    """
    n, out, used = len(rows), [], set()
    filled = signatures > 0
    for _ in range(forests if n > 2 else 1):
        best, source, free = np.full(n, -1.0), np.zeros(n, np.int64), np.ones(n, bool)
        for _ in range(n):
            at = int(np.argmax(np.where(free, best, -2.0)))
            if best[at] >= ESTIMATE:
                pair = (min(at, int(source[at])), max(at, int(source[at])))
                used.add(pair)
                out.append((int(min(rows[pair[0]], rows[pair[1]])), int(max(rows[pair[0]], rows[pair[1]]))))
            free[at] = False
            either = (filled | filled[at]).sum(axis=1)
            weight = ((signatures == signatures[at]) & filled).sum(axis=1) / np.maximum(either, 1)
            for a, b in used:
                if at in (a, b):
                    weight[b if at == a else a] = -1.0
            closer = free & (weight > best)
            best[closer], source[closer] = weight[closer], at
    return out


def crossing_pairs(roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of different roots that some two sets of at least ``similarity`` join, by exact counts over all pairs of sets.

    Sets that are joined already are not compared; sets of small components go
    first, so that the members of the largest are never compared with each other.
    """
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    found, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label, out = np.zeros(len(found), np.uint8), roots.copy(), []
    _, own, members = np.unique(roots, return_inverse=True, return_counts=True)
    order = np.argsort(members[own], kind="stable")
    for i, at in enumerate(order.tolist()):
        if (label[order[i:]] == label[at]).all():
            break  # every pair of two components has been compared
        mark[ids[starts[at] : ends[at]]] = 1
        both = np.add.reduceat(mark[ids], starts, dtype=np.int64)
        mark[ids[starts[at] : ends[at]]] = 0
        for j in np.flatnonzero((label != label[at]) & (both >= similarity * (sizes + sizes[at] - both))).tolist():
            if label[j] != label[at]:
                out.append((int(min(roots[at], roots[j])), int(max(roots[at], roots[j]))))
                label[label == label[j]] = label[at]
    return out


_KEYS = ("kind", "print", "low", "high")


def _grouped(solve: Callable[[pa.Table], list[tuple[int, int]]]):
    """A ``mapInArrow`` function: the pairs that ``solve`` finds in each group of rows sorted by (kind, print, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs_of(part: pa.Table, keys: np.ndarray) -> pa.RecordBatch:
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            found = [p for a, b in zip(edges, edges[1:], strict=False) if b - a > 1 for p in solve(part.slice(a, b - a))]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([*held, batch]).combine_chunks()
            keys = np.stack([part[k].to_numpy() for k in _KEYS], axis=1)
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield pairs_of(part.slice(0, cut), keys[:cut])
            held = part.slice(cut).to_batches()
        if held:
            part = pa.Table.from_batches(held).combine_chunks()
            yield pairs_of(part, np.stack([part[k].to_numpy() for k in _KEYS], axis=1))

    return run


def _spanning(part: pa.Table) -> list[tuple[int, int]]:
    return spanning_pairs(part["row"].to_numpy(), np.frombuffer(b"".join(part["signature"].to_pylist()), "<u2").reshape(-1, BINS))


def _blocked(members: DataFrame, blocks: Column) -> DataFrame:
    """``members`` once for each task (low, high) they meet in: groups of more than two ``blocks`` are dealt so that every two meet."""
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own)
    others = F.when(F.col("blocks") <= 2, F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("own")), lambda j: F.struct(F.least(j, F.col("own")).alias("low"), F.greatest(j, F.col("own")).alias("high")))
    )
    return dealt.withColumn("o", F.explode(others)).select("*", "o.low", "o.high").drop("blocks", "own", "o")


def _with_pivots(members: DataFrame, blocks: Column) -> DataFrame:
    """``members`` in ``blocks`` tasks a group (low, high = low); the rows of the ``PIVOTS`` least hashes of a group are in all of its tasks."""
    at = F.xxhash64("row", "kind")
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("at", at)
    large = dealt.where("blocks > 1")
    # the least of each block first, so that a large group is never sorted in one task
    first = Window.partitionBy("kind", "print", "own").orderBy("at", "row")
    then = Window.partitionBy("kind", "print").orderBy("at", "row")
    few = large.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= PIVOTS)
    few = few.withColumn("rank", F.row_number().over(then)).where(F.col("rank") <= PIVOTS)
    shared = few.withColumn("low", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("low <> own")
    both = dealt.withColumn("low", F.col("own")).select("row", "kind", "print", "low").unionByName(shared.select("row", "kind", "print", "low"))
    return both.withColumn("high", F.col("low"))


def _solved(dealt: DataFrame, solve: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    return dealt.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "row").mapInArrow(_grouped(solve), "a long, b long").distinct()


def sketch_members(coded: DataFrame) -> DataFrame:
    """(row, kind, print, n): the groups of rows with words that share a sketch or, as the last kind, the fingerprint."""
    groups = coded.where("size > 0").select("row", F.posexplode(F.concat("sketches", F.array("fp"))).alias("kind", "print"))
    sizes = materialize(groups.groupBy("kind", "print").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    return materialize(spread_join(groups, sizes, "kind", "print"), "members")


def sketch_pairs(coded: DataFrame, members: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of rows: the spanning pairs of each group.

    Groups of more than ``BLOCK`` rows are dealt in blocks; ``PIVOTS`` rows of the
    group are in each of its blocks and hold them together, so that the work is in
    proportion to the rows. Pairs that this misses are met by ``unsettled_pairs``.
    """
    dealt = _with_pivots(members, F.ceil(F.col("n") / BLOCK).cast("int")).select("row", *_KEYS)
    return _solved(dealt.join(coded.select("row", "signature"), "row"), _spanning)


def unsettled_pairs(single: DataFrame, rooted: DataFrame, members: DataFrame, linked: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): roots to be joined, from every pair of similar rows that meet and have different roots.

    ``rooted`` is (row, fp, size, root) of the rows with words; ``linked`` has
    pairs (a, b) of close fingerprints. Rows meet in the groups of ``members``,
    and where their fingerprints are linked. Groups of one root are done;
    in the others all pairs of two roots are compared by their shingle sets, those
    of the largest root with each of the others only. The pairs are a table of
    their own, and the shingle sets are gone.
    """
    ends = rooted.groupBy("fp").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    a, b = (ends.select(F.col("fp").alias(k), F.col("least").alias(f"{k}_least"), F.col("most").alias(f"{k}_most")) for k in ("a", "b"))
    apart = linked.join(a, "a").join(b, "b").where(F.least("a_least", "b_least") < F.greatest("a_most", "b_most"))
    crossed = apart.select(F.lit(SKETCHES + 1).alias("kind"), F.xxhash64("a", "b").alias("print"), F.explode(F.array("a", "b")).alias("fp"))
    crossed = crossed.join(rooted, "fp").select("row", "kind", "print", "size", "root")
    met = members.select("row", "kind", "print").join(rooted.select("row", "size", "root"), "row").unionByName(crossed)
    # of each group its largest root, and the rows and shingles of that root and of the others
    owned = met.groupBy("kind", "print", "root").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    sizes = owned.groupBy("kind", "print").agg(
        F.max(F.struct("n", "root", "total")).alias("most"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("*").alias("roots")
    )
    sizes = sizes.where("roots > 1").select("kind", "print", F.col("most.root").alias("major"), F.col("most.n").alias("major_n"), F.col("most.total").alias("major_total"), "n", "total")
    unsettled = materialize(spread_join(met, materialize(sizes, "unsettled"), "kind", "print").drop("size"), "unsettled-members")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["row", "shingles"])

    def solve(part: pa.Table) -> list[tuple[int, int]]:
        return crossing_pairs(part["root"].to_numpy(), [np.frombuffer(x, np.uint64) for x in part["shingles"].to_pylist()], similarity)

    sets = standing(single.select("row", "text"), "row", unsettled.select("row")).mapInArrow(in_slices(run), "row long, shingles binary")
    sets = materialize(sets, "shingles")
    more = materialize(_solved(_crossing(unsettled).join(sets, "row"), solve), "more")
    drop_table(sets)
    return more


def _crossing(unsettled: DataFrame) -> DataFrame:
    """``unsettled`` dealt so that every two rows of a group meet that have different roots.

    Rows of a group's largest root are dealt in blocks that do not meet each
    other; each block of the other rows meets all of those and all of its own kind.
    """
    n, total = F.col("n") - F.col("major_n"), F.col("total") - F.col("major_total")
    blocks = F.ceil(F.greatest(n / MEMBERS, total / SHINGLES) * 2).cast("int")
    parts = F.ceil(F.greatest(F.col("major_n") / BLOCK, F.col("major_total") * 4 / SHINGLES)).cast("int")
    # up to two blocks go into one task, as in _blocked
    sized = unsettled.withColumn("blocks", F.when(blocks > 2, blocks).otherwise(1)).withColumn("parts", F.greatest(parts, F.lit(1)))
    columns, at = ["row", "root", *_KEYS], F.xxhash64("row")
    minor, major = sized.where("root <> major"), sized.where("root = major")
    inner = _blocked(minor.where("blocks > 1").drop("parts"), F.col("blocks"))
    few = minor.withColumn("low", F.pmod(at, F.col("blocks")).cast("int")).withColumn("high", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    many = major.withColumn("high", F.pmod(at, F.col("parts")).cast("int") + 1).withColumn("low", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    outer = few.unionByName(many).withColumn("high", -F.col("high"))
    return inner.select(*columns).unionByName(outer.select(*columns))


def _digests(stored: DataFrame, row: str) -> DataFrame:
    """(row, digest, text) of every row; texts without words have one digest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.when(text.rlike(r"[^ \t-\r]"), text).otherwise(F.lit(""))
    return stored.select(F.col(row).alias("row"), F.unhex(F.md5(words)).alias("digest"), text.alias("text"))


def _classes(stored: DataFrame, row: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(digest, row, n): the classes of equal texts with their first row; and (row, fp, sketches, signature, size) of those rows.

    Every row is coded where it is read, copies too: their codes are far smaller
    than the texts that would have to be told apart by a shuffle before.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2).to_pylist()
        fps = pa.array(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))
        sets = [shingle_set(t, width) for t in texts]
        drawn = pa.array([np.array(sketches(s), np.uint64).view(np.int64).tolist() for s in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), fps, drawn, pa.array([signature(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32())],
            names=["row", "digest", "fp", "sketches", "signature", "size"],
        )

    every = materialize(_digests(stored, row).mapInArrow(in_slices(run), "row long, digest binary, fp long, sketches array<long>, signature binary, size int"), "codes")
    classes = materialize(every.groupBy("digest").agg(F.min("row").alias("row"), F.count("*").alias("n")), "texts")
    coded = materialize(standing(every.drop("digest"), "row", classes.select("row")), "sketches")
    drop_table(every)
    return classes, coded


def _class_roots(stored: DataFrame, row: str, coded: DataFrame, width: int, similarity: float) -> DataFrame:
    """(row, root): the first rows of the classes that are near copies of others, and the first row of each group."""
    single = stored.select(F.col(row).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    owners = coded.groupBy("fp").agg(F.min("row").alias("row"))
    close = materialize(links(coded.select("fp")), "links")
    linked = close.join(owners.select(F.col("fp").alias("a"), F.col("row").alias("ra")), "a").join(owners.select(F.col("fp").alias("b"), F.col("row").alias("rb")), "b")
    members = sketch_members(coded)
    pairs = linked.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).unionByName(sketch_pairs(coded, members)).distinct()
    edges = materialize(_similar(single, materialize(pairs, "pairs"), width, similarity), "similar")
    found = materialize(components(edges), "found")
    rooted = coded.where("size > 0").select("row", "fp", "size").join(found.withColumnRenamed("node", "row"), "row", "left")
    rooted = materialize(rooted.withColumn("root", F.coalesce("root", "row")), "rooted")
    more = unsettled_pairs(single, rooted, members, close, width, similarity)
    drop_table(coded)
    if not more.isEmpty():
        joined = materialize(components(more), "joined")
        lone = joined.join(found, "node", "left_anti")
        found = found.join(joined.select(F.col("node").alias("root"), F.col("root").alias("low")), "root", "left").select("node", F.coalesce("low", "root").alias("root")).unionByName(lone)
    return found.select(F.col("node").alias("row"), "root")


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    (row,) = fresh(docs, "row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "copies"), row


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> tuple[DataFrame, str, DataFrame]:
    """``docs`` with a row number, the name of its column, and (row, root) of all rows: the group of each is that of the row ``root``.

    Exact copies are one class, and so are texts without words; each class goes
    on as its first row. First candidates are the links of whole-text
    fingerprints and the spanning pairs of groups of equal sketches or
    fingerprints, each verified by the similarity of the shingle sets; they
    settle most groups without expanding their pairs. Where rows of a group, or
    of linked fingerprints, still have different roots, all their pairs are
    compared.

    Defined results: null and empty texts count as texts without words; repeated
    rows are exact copies, of which the first in the order of the table is the
    root; an empty table gives empty results; only ``text`` is read, and the row
    number takes a name that no column has.
    """
    stored, row = _numbered(docs)
    classes, coded = _classes(stored, row, width)
    found = _class_roots(stored, row, coded, width, similarity)
    roots = classes.join(found, "row", "left").select("digest", "n", F.coalesce("root", "row").alias("root"))
    return stored, row, spread_join(_digests(stored, row).drop("text"), roots, "digest").select("row", "root")


def drop_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies: the first row of the group. Results are defined as in :func:`near_copies`."""
    stored, row = _numbered(docs)
    classes, coded = _classes(stored, row, width)
    found = _class_roots(stored, row, coded, width, similarity)
    kept = classes.select("row").join(found.where("row <> root").select("row"), "row", "left_anti")
    return standing(stored, row, kept).select(*columns_of(docs))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
