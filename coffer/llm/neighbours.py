"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first.

The tree is fitted on a sample that grows with the square root of the table, up
to a bound; every row is assigned to a leaf. A query walks the tree through a
priority queue by distance to the centroids and visits leaves in that order.
How many leaves is calibrated: for a sample of queries the true neighbours are
found by brute force over all rows, and visits widen until the wanted recall is
reached (and until enough rows are visited).

Whole leaves that lie beside each other in the tree make a shard of bounded
bytes; a leaf beyond the bound is dealt over several shards. One task holds the
vectors of one shard and the queries that visit it stream by, so that a query
gives one row of at most ``k + 1`` candidates for a shard, however many leaves
it visits there. Equal vectors are one class throughout: all its rows lie at
one distance, so only its smallest ids can be among the nearest, and its
queries are asked once.

Defined results: vectors that are null, zero, or that hold null or non-finite
components take no part, nor do rows with null ids; vectors of different
lengths have no distance, so each length is searched on its own; rows that
share the query's id are its own; repeated rows are candidates each, so one id
can be listed more than once; an id on several vectors is asked with each of
them, and the nearest of all are listed; ties go to the smaller id; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coffer.llm.common import materialize, table

#: The tree's sample: at least so many classes, so many for each square root of the table, at most so many.
SAMPLE_LEAST, SAMPLE_EACH, SAMPLE_MOST = 20_000, 32, 200_000
#: Queries that the visits are calibrated on, at most.
CALIBRATION = 150
BRANCHING, LEAF_SAMPLE = 8, 32
#: Shards of a table, about, while their vectors (8 bytes a component) stay within the bound; and bytes of compared distances held at once.
SHARDS, SHARD_BYTES, NEAR_BYTES = 64, 48 << 20, 32 << 20
TARGET_RECALL = 0.97


@dataclass
class Tree:
    centroids: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)  # leaf number of a node, -1 for inner nodes

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest child at every level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            c = self.centroids[kids]
            near = ((c * c).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
            todo += [(int(k), rows[near == j]) for j, k in enumerate(kids) if (near == j).any()]
        return out

    def order(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first; centroids are compared as their parents are reached."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            kids = self.children[node]
            if kids:
                distance = ((self.centroids[kids] - query) ** 2).sum(axis=1).tolist()
                for kid, far in zip(kids, distance, strict=True):
                    heapq.heappush(queue, (far, kid))


def fit_tree(x: np.ndarray, branching: int = BRANCHING, leaf_rows: int = LEAF_SAMPLE, seed: int = 5) -> Tree:
    """Hierarchical k-means; leaves are numbered along the tree, so that neighbours in number are neighbours in it.

    A node that k-means leaves in one piece, as where all its rows are alike, is a leaf.
    """
    rng = np.random.default_rng(seed)
    centroids, children, leaf, leaves = [x.mean(axis=0)], [[]], [-1], 0
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        parts = []
        if len(rows) > leaf_rows:
            own = x[rows]
            c = own[rng.choice(len(rows), min(branching, len(rows)), replace=False)]
            for _ in range(8):
                near = ((c * c).sum(axis=1) - 2 * own @ c.T).argmin(axis=1)
                c = np.stack([own[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
            near = ((c * c).sum(axis=1) - 2 * own @ c.T).argmin(axis=1)
            parts = [(j, rows[near == j]) for j in range(len(c)) if (near == j).any()]
        if len(parts) <= 1:
            leaf[node] = leaves
            leaves += 1
            continue
        for j, part in parts:
            children[node].append(len(centroids))
            todo.append((len(centroids), part))
            centroids.append(c[j])
            children.append([])
            leaf.append(-1)
    return Tree(np.stack(centroids), children, leaf)


def _nearest(q: np.ndarray, near: np.ndarray, x: np.ndarray, norm: float, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (places in ``x``, distances) of its ``k`` nearest by distance, then id.

    ``near`` are squared distances by a product, infinite where a row is no
    candidate. They select with a margin for their rounding; distances are then
    computed from differences in double precision.
    """
    limit = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] > k else np.full(len(q), np.inf)
    margin = 1e-9 * (norm + (q * q).sum(axis=1) + 1)
    for i in range(len(q)):
        picked = np.flatnonzero((near[i] <= limit[i] + margin[i]) & np.isfinite(near[i]))
        distance = np.sqrt(((x[picked] - q[i]) ** 2).sum(axis=1))
        best = np.lexsort((ids[picked], distance))[:k]
        yield picked[best], distance[best]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(embedding, ids, first): each different vector once, with its ``k`` smallest ids, how often each occurs, and the least.

    Rows are counted before the shuffle, and the rank limit works before it too,
    so a very common vector sends ``k`` rows from each task.
    """
    counted = rows.groupBy("embedding", "vec_id").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("place") <= k)
    return ranked.groupBy("embedding").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids")).withColumn("first", F.col("ids")[0]["vec_id"])


def brute_force(rows: DataFrame, dim: int, queries: np.ndarray, query_ids: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` nearest rows of other ids for a bounded set of queries, against all rows (vec_id, embedding) in blocks."""
    known = rows.sparkSession.sparkContext.broadcast((queries, query_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, q_ids = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _vectors(batch.column(1), dim), np.asarray(batch.column(0))
            norms = (x * x).sum(axis=1)
            near = norms - 2 * q @ x.T + (q * q).sum(axis=1)[:, None]
            near[q_ids[:, None] == ids] = np.inf
            found = list(_nearest(q, near, x, norms.max(), ids, k))
            at = np.concatenate([p for p, _ in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q_ids, [len(p) for p, _ in found])), pa.array(ids[at]), pa.array(np.concatenate([d for _, d in found]))],
                names=["query_id", "vec_id", "score"],
            )

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = rows.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def calibrate(placed: DataFrame, dim: int, tree: Tree, k: int, every: int, target: float, most: int) -> tuple[int, float]:
    """The number of leaf visits whose recall over a sample of queries reaches ``target``; and that recall.

    Truth are the ``k`` nearest other classes of each query's own.
    """
    asked = F.exists("ids", lambda i: F.pmod(i.vec_id, F.lit(every)) == 0)
    picked = placed.where(asked).orderBy(F.xxhash64("embedding"), "class").limit(most).collect()
    if not picked:
        return 1, 1.0
    queries, own = np.array([r.embedding for r in picked]), np.array([r["class"] for r in picked])
    rows = placed.select(F.col("class").alias("vec_id"), "embedding", "leaf")
    truth = brute_force(rows, dim, queries, own, k).join(rows.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()
    places = {int(i): {leaf: n for n, leaf in enumerate(tree.order(q))} for i, q in zip(own, queries, strict=True)}
    needed = np.sort([places[r.query_id][r.leaf] for r in truth]) + 1
    if not len(needed):
        return 1, 1.0
    visits = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])
    return visits, float((needed <= visits).mean())


def shards_of(held: dict[int, int], rows: int) -> dict[int, tuple[int, int]]:
    """(first shard, shards) of each leaf: runs of leaves of about ``rows`` rows, larger leaves in shards of their own."""
    out, shard, room = {}, -1, 0
    for leaf in sorted(held):
        n = held[leaf]
        if n > rows:
            parts = -(-n // rows)
            out[leaf] = (shard + 1, parts)
            shard, room = shard + parts, 0
            continue
        if n > room:
            shard, room = shard + 1, rows
        out[leaf] = (shard, 1)
        room -= n
    return out


def _meeting(dim: int, k: int):
    """A ``mapInArrow`` function over rows sorted by (shard, asked, leaf): members of a shard come first and are held, its queries stream by."""

    def compare(part: pa.RecordBatch, x: np.ndarray, own: np.ndarray, first: np.ndarray, leaf: np.ndarray) -> Iterator[pa.RecordBatch]:
        norms = (x * x).sum(axis=1)
        names, begin = np.unique(leaf, return_index=True)
        end = np.append(begin[1:], len(leaf))
        lists = part["leaves"]
        # queries that visit alike share their columns
        for a in range(0, part.num_rows, step := max(1, NEAR_BYTES // (8 * len(x)))):
            q = _vectors(part["embedding"].slice(a, step), dim)
            visited = lists.slice(a, step)
            row = np.repeat(np.arange(len(q)), np.asarray(pa.compute.list_value_length(visited)))
            at = np.searchsorted(names, np.asarray(visited.flatten()))
            order = np.argsort(at, kind="stable")
            row, at = row[order], at[order]
            near = np.full((len(q), len(x)), np.inf)
            for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1) if len(at) else ():
                b, e, rows = begin[at[cut[0]]], end[at[cut[0]]], row[cut]
                near[rows, b:e] = norms[b:e] - 2 * q[rows] @ x[b:e].T + (q[rows] * q[rows]).sum(axis=1)[:, None]
            found = list(_nearest(q, near, x, norms.max(), first, k))
            places = np.concatenate([p for p, _ in found])
            bounds = np.concatenate([[0], np.cumsum([len(p) for p, _ in found])]).astype(np.int32)
            kind = pa.StructArray.from_arrays([pa.array(np.concatenate([d for _, d in found])), pa.array(first[places]), pa.array(own[places])], names=["score", "first", "class"])
            yield pa.RecordBatch.from_arrays([part["class"].slice(a, step), pa.ListArray.from_arrays(pa.array(bounds), kind)], names=["asked", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, built = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch["shard"]), np.asarray(batch["asked"]).astype(np.int64)])
            edges = np.concatenate([[0], np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1, [batch.num_rows]])
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if key[0, a] != shard:
                    shard, held, built = key[0, a], [], None
                if not key[1, a]:
                    held.append([_vectors(part["embedding"], dim), *(np.array(part[c]) for c in ("class", "first", "leaf"))])
                    continue
                if held:
                    built, held = [np.concatenate(c) for c in zip(*held, strict=True)], []
                if built:
                    yield from compare(part, *built)

    return run


FOUND = "array<struct<score:double,first:long,class:long>>"


def _search(rows: DataFrame, dim: int, k: int, every: int, target: float) -> DataFrame | None:
    """(query_id, vec_id, score) of at least the ``k`` nearest rows found, for vectors of one length; None without any."""
    spark = rows.sparkSession
    # one id and one class more than asked for: a query's own are taken out at the end
    classes = materialize(classes_of(rows, k + 1).withColumn("class", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    wanted = int(min(SAMPLE_MOST, max(SAMPLE_LEAST, SAMPLE_EACH * total**0.5)))
    drawn = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30))
    # the rate draws a little more than wanted; what comes is cut to it in order of the draw
    rate = min(1.0, 1.05 * wanted / max(total, 1) + 100 / max(total, 1))
    sample = classes.where(drawn < int(rate * (1 << 30)) + 1).select(drawn.alias("drawn"), "embedding").toArrow().sort_by("drawn").slice(0, wanted)
    if not sample.num_rows:
        return None
    tree = fit_tree(_vectors(sample["embedding"].combine_chunks(), dim))
    known = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = known.value.assign(_vectors(batch["embedding"], dim)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    kinds = "class long, first long, embedding array<double>, ids array<struct<vec_id:long,n:long>>"
    placed = materialize(classes.select("class", "first", "embedding", "ids").mapInArrow(assign, f"{kinds}, leaf long"), "leaves")
    visits, _ = calibrate(placed, dim, tree, k, every, target, CALIBRATION)
    held = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # one row for each leaf of the tree
    most = max(1, min(SHARD_BYTES // (8 * dim), max(1024, -(-total // SHARDS))))
    shards = shards_of(held, most)
    dealt = spark.sparkContext.broadcast((held, shards))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shards = dealt.value
        for batch in batches:
            at, where, lists = [], [], []
            for i, q in enumerate(_vectors(batch["embedding"], dim)):
                seen, parts = 0, {}
                for n, leaf in enumerate(known.value.order(q)):
                    if n >= visits and seen > 2 * k:
                        break
                    seen += held.get(leaf, 0)
                    first, count = shards.get(leaf, (0, 0))
                    for shard in range(first, first + count):
                        parts.setdefault(shard, []).append(leaf)
                at += [i] * len(parts)
                where += parts
                lists += parts.values()
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int64()), batch["class"].take(take), batch["embedding"].take(take), pa.array(lists, pa.list_(pa.int64()))], names=["shard", "class", "embedding", "leaves"]
            )

    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).join(classes.select("embedding", "class"), "embedding").select(F.col("vec_id").alias("query_id"), "class")
    queries = materialize(queries.distinct(), "queries")
    asked = placed.join(queries.select("class").distinct(), "class", "left_semi").select("class", "embedding")
    asked = asked.mapInArrow(visit, "shard long, class long, embedding array<double>, leaves array<long>").withColumn("asked", F.lit(True))
    # one row for each leaf of the tree, which the sample bounds
    numbers = spark.createDataFrame([(leaf, first, count) for leaf, (first, count) in shards.items()], "leaf long, shard_first long, shard_count long")
    shard = F.col("shard_first") + F.pmod(F.xxhash64("class"), F.col("shard_count"))
    members = placed.join(F.broadcast(numbers), "leaf").select(shard.alias("shard"), "class", "first", "embedding", "leaf", F.lit(False).alias("asked"))
    met = members.unionByName(asked, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "asked", "leaf", "class")
    found = met.mapInArrow(_meeting(dim, k + 1), f"asked long, found {FOUND}")
    # a query's candidates are k + 1 for each shard that it visits
    merged = found.groupBy("asked").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    near = merged.select("asked", F.explode("found").alias("f")).select("asked", "f.score", "f.class")
    near = near.join(placed.select("class", "ids"), "class").select(F.col("asked").alias("class"), "score", "ids")
    answers = queries.join(near, "class").select("query_id", "score", F.explode("ids").alias("i")).where("i.vec_id <> query_id")
    copies = F.explode(F.sequence(F.lit(1), F.least(F.col("i.n"), F.lit(k)).cast("int")))
    return answers.select("query_id", F.col("i.vec_id").alias("vec_id"), "score", copies.alias("copy")).drop("copy")


def search(vectors: DataFrame, k: int = 10, every: int = 100, target: float = TARGET_RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for every row whose id is divisible by ``every``."""
    rows = usable(vectors)
    found = None
    for n in sorted(r.n for r in rows.select(F.size("embedding").alias("n")).distinct().collect()):  # the lengths in use, one as a rule
        part = _search(rows.where(F.size("embedding") == n), n, k, every, target)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
