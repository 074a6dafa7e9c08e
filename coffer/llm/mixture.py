"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of packets (documents, cut at ``length`` tokens). Each
window gives a queue a quantum of ``window * share`` tokens; a packet leaves in
the first window whose cumulative quanta cover it, what is left of the quantum
is carried as the queue's deficit. While a queue has packets its deficit never
resets, so the window of a packet is ``ceil(end / quantum) - 1`` with ``end``
the tokens of its queue up to and with it: the round-robin runs without a
sequential pass, and the deficits carry across windows and across partitions
through prefix sums of per-partition queue totals. Windows follow each other in
one token stream that is cut into sequences of ``length``, so only the very
last sequence has padding.

Shares default to the sources' shares of all tokens, which keeps every window
at the corpus mixture until the queues end together; other ``weights`` set
other mixtures, and a queue that ends early leaves its windows to the others.

Defined results: null text is empty and yields its end id alone; a null source
shares the queue of the empty source name; null ids and repeated rows are
packed like any others; an empty table gives an empty result; only doc_id,
text and source are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coffer.llm.common import materialize, slices, table
from coffer.llm.tokens import word_bpe_path, word_ids

TOKENIZE_BYTES = 8 << 20
#: Tables of this many rows (some tens of bytes each) or fewer are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000

PACKETS = "doc_id long, queue string, part int, start long, length long, doc_tokens long, before long, ids binary"


def packets(docs: DataFrame, length: int, tokenizer: str, end_id: int) -> DataFrame:
    """Tokenised packets: ``ids`` are little-endian unsigned 32-bit; ``before`` counts the queue's earlier tokens in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        coder = word_ids(tokenizer)
        for batch in batches:
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0))
            for a, b in slices(sizes, TOKENIZE_BYTES):
                ids, offsets = coder.encode(batch.column(1).slice(a, b - a), end_id)
                out: list[tuple] = []
                for i, (doc, queue) in enumerate(zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_pylist(), strict=True)):
                    first, total = int(offsets[i]), int(offsets[i + 1] - offsets[i])
                    for start in range(0, total, length):
                        n = min(length, total - start)
                        before = seen.get(queue, 0)
                        seen[queue] = before + n
                        out.append((doc, queue, part, start, n, total, before, ids[first + start : first + start + n].tobytes()))
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PACKETS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"))
    return rows.mapInArrow(run, PACKETS)


def sized_join(rows: DataFrame, small: DataFrame, on: list[str], count: int) -> DataFrame:
    """Join by broadcast where ``small`` has few rows, else as Spark plans it."""
    return rows.join(F.broadcast(small) if count <= BROADCAST_ROWS else small, on)


def pack(
    docs: DataFrame,
    length: int = 4096,
    window: int = 256 * 4096,
    weights: dict[str, float] | None = None,
    tokenizer: str | None = None,
    end_id: int = 2,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document in a packed sequence.

    Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    window_id, queue; and ``ids`` (binary) if ``with_ids``.
    """
    rows = materialize(packets(docs, length, tokenizer or word_bpe_path(), end_id), "packets")
    spark = rows.sparkSession
    sums = rows.groupBy("queue", "part").agg(F.sum("length").alias("tokens"))
    ordered = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    entry = materialize(sums.withColumn("base", F.coalesce(F.sum("tokens").over(ordered), F.lit(0))), "queues")
    totals = {r.queue: (r.tokens, r.parts) for r in entry.groupBy("queue").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts")).collect()}
    total = sum(t for t, _ in totals.values())
    shares = {q: (weights or {}).get(q, 0.0) if weights else t / total for q, (t, _) in totals.items()}
    given = sum(shares.values()) or 1.0
    # a queue without a weight still has to be packed: it gets one token in a thousand
    quanta = [(q, max(window * shares[q] / given, window / 1000 if weights else 0.0)) for q in totals]
    quantum = spark.createDataFrame(quanta, "queue string, quantum double")
    entry = sized_join(entry.select("queue", "part", "base"), quantum, ["queue"], len(quanta))
    placed = sized_join(rows, entry, ["queue", "part"], sum(p for _, p in totals.values()))
    placed = placed.withColumn("begin", F.col("base") + F.col("before"))
    placed = placed.withColumn("window_id", F.ceil((F.col("begin") + F.col("length")) / F.col("quantum")).cast("long") - 1)

    runs = placed.groupBy("window_id", "queue").agg(F.sum("length").alias("n"), F.min("begin").alias("first"))
    runs = materialize(runs.withColumn("block", F.floor(F.col("window_id") / 1024)), "runs")
    blocks = runs.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("block_base"))
    inside = Window.partitionBy("block").orderBy("window_id", "queue").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.withColumn("in_block", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "block")
    bases = materialize(bases.select("window_id", "queue", (F.col("block_base") + F.col("in_block") - F.col("first")).alias("shift")), "bases")

    stream = sized_join(placed, bases, ["window_id", "queue"], runs.count()).withColumn("at", F.col("shift") + F.col("begin"))
    room = F.lit(length) - F.col("at") % length
    cut = F.least(room, F.col("length"))
    pieces = F.array(F.struct(F.lit(0).cast("long").alias("a"), cut.alias("n")), F.struct(cut.alias("a"), (F.col("length") - cut).alias("n")))
    stream = stream.withColumn("p", F.explode(F.filter(pieces, lambda p: p.n > 0)))
    ids = F.expr("substring(ids, cast(4 * p.a + 1 as int), cast(4 * p.n as int))")
    place = F.col("at") + F.col("p.a")
    return stream.select(
        "doc_id", (F.col("start") + F.col("p.a")).alias("start"), F.col("p.n").alias("length"), F.crc32(ids).alias("ids_crc32"), "doc_tokens",
        F.floor(place / length).cast("long").alias("sequence_id"), (place % length).alias("offset"), "window_id", "queue", *([ids.alias("ids")] if with_ids else []),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
