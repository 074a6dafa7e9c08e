"""Shared helpers: working folder, materialised tables, numpy text kernels.

Everything here runs either on the driver as plan construction or inside Spark
tasks on one Arrow batch at a time; no helper holds a whole table.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Texts of one Arrow batch are handled in slices of about this many bytes.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, as in tests, a temporary folder will do if the
    master is ``local``, which has one machine; on a cluster it would leave every
    executor with its own part of a table, so that is refused.
    """
    key, own = "spark.checkpoint.dir", "spark.coffer.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key) or spark.conf.get(own, None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{key} is not set; it has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="coffer-")
        spark.conf.set(own, found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/coffer/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`materialize`."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fold(column, modulus: int):
    """crc32 of an integer id's text, modulo ``modulus``; null ids count as text ''."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about ``limit``; each has one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of ``df`` whatever marks their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: Shares of all rows that one key may hold before :func:`spread_join` cuts it.
SHARES = 1024


def spread_join(rows: DataFrame, keyed: DataFrame, *on: str) -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row for each key and the number of its rows as ``n``.

    A key with more than one of :data:`SHARES` of all rows is cut into pieces of
    that size. There are at most so many such keys, so their names are
    broadcast whatever the size of the tables.
    """
    total = keyed.agg(F.sum("n")).first()[0] or 0
    most = max(64, -(-total // SHARES))
    pieces = F.ceil(F.col("n") / most).cast("int")
    hot = keyed.where(F.col("n") > most).select(*on, pieces.alias("pieces"))
    dealt = rows.join(F.broadcast(hot), list(on), "left")
    dealt = dealt.withColumn("piece", F.pmod(F.monotonically_increasing_id(), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")
    copies = keyed.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return dealt.join(copies, [*on, "piece"]).drop("piece")


#: Bitmaps that are broadcast at most, of 4 KiB and 32,768 successive numbers each.
BITMAPS = 16_384


def standing(rows: DataFrame, key: str, numbers: DataFrame, keep: bool = True) -> DataFrame:
    """The ``rows`` whose long ``key`` is among the ``numbers`` (one column), or without ``keep`` the others; rows stay where they are.

    A bit for each number is broadcast, so that no text goes through a shuffle
    to be left out after it. Beyond :data:`BITMAPS`, some 500 million row
    numbers, rows and numbers are joined as Spark plans it.
    """
    number = numbers.columns[0]
    placed = numbers.select(F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("place"))
    # by bucket first: partial bitmaps of every task would be far larger than their numbers
    bits = materialize(placed.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")), "bits")
    if bits.count() > BITMAPS:
        return rows.join(numbers.toDF(key).distinct(), key, "left_semi" if keep else "left_anti").select(*columns_of(rows))
    bucket, held = fresh(rows, "bucket", "bits")
    marked = rows.withColumn(bucket, F.bitmap_bucket_number(key)).join(F.broadcast(bits.toDF(bucket, held)), bucket, "inner" if keep else "left")
    byte = f"ascii(decode(substring({held}, cast(bitmap_bit_position({key}) div 8 as int) + 1, 1), 'ISO-8859-1'))"
    bit = F.expr(f"shiftright({byte}, cast(bitmap_bit_position({key}) % 8 as int)) & 1")
    return marked.where(F.coalesce(bit, F.lit(0)) == int(keep)).select(*columns_of(rows))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def in_slices(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text", row_bytes: int = 0):
    """A ``mapInArrow`` function that applies ``fn`` to slices bounded by text bytes, each row counting ``row_bytes`` at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0))
            for a, b in slices(np.maximum(sizes, row_bytes)):
                out = fn(batch.slice(a, b - a))
                if out is not None and out.num_rows:
                    yield out

    return run


def map_whole(docs: DataFrame, fn: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch], *more: StructField, row_bytes: int = 0) -> DataFrame:
    """All columns of ``docs``, whatever marks their names hold, and ``more``: ``fn`` gets slices of rows and their texts."""
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    text = plain[names.index("text")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return fn(batch, texts_of(batch.column(batch.schema.get_field_index(text))))

    fields = [StructField(n, f.dataType) for n, f in zip(plain, docs.schema.fields, strict=True)]
    made = docs.toDF(*plain).mapInArrow(in_slices(run, text, row_bytes), StructType([*fields, *more]))
    return made.toDF(*names, *[f.name for f in more])


# --------------------------------------------------------------------------
# Vectorised hashing: polynomial prefix sums over a byte table, modulo 2**64.

_RNG = np.random.default_rng(20240607)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to ``n``."""
    if len(_POWERS.get("base", ())) < n:
        size = max(n, 1 << 16)
        for name, value in (("base", _BASE), ("inverse", _INVERSE)):
            out = np.full(size, value, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["base"][:n], _POWERS["inverse"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums S with S[i] = sum of values[j] * base**j for j < i."""
    power, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), equal for equal content at any place."""
    _, inverse = _powers(len(prefix))
    return (prefix[end] - prefix[start]) * inverse[start]


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def lowered(text: str) -> str:
    """Lower case, code point by code point, so that places stay those of ``text``."""
    whole = text.lower()
    return whole if len(whole) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased texts: (bytes, hash, row, start, end) with byte places in the joined buffer.

    A word is a run of ASCII letters, digits and non-ASCII characters.
    """
    blobs = [lowered(t).encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(b) + 1 for b in blobs], np.int64)
    data = np.frombuffer(b" ".join([*blobs, b""]) if blobs else b"", np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    prefix = prefix_hash(_TABLE[data])
    row = np.searchsorted(np.cumsum(sizes), start, side="right")
    return data, mix(span_hash(prefix, start, end)), row, start, end


def gram_hash(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` successive words of one row, and the index of each one's first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    prefix = prefix_hash(words)
    return mix(span_hash(prefix, at, at + n)), at


def crc_text(value) -> int:
    return zlib.crc32(str(value).encode())
