"""File trees as pack items, and extraction into a tree.

Both sides use a file system that all executors mount.
"""

from __future__ import annotations

import datetime
import os
import shutil
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from coffer.functions import attributes as A
from coffer.functions import names as N
from coffer.sources import archives

ITEMS = "archive string, name string, source string, is_directory boolean, is_symlink boolean, is_junk boolean, modified timestamp_ntz"
#: Bytes of a block of a file.
BLOCK_BYTES = 8 << 20


def _item(archive: str, source: str, name: str, top: bool) -> dict:
    link = os.path.islink(source)
    folder = os.path.isdir(source) and not link
    junk = any(c in N.JUNK_NAMES or c.startswith(N.JUNK_PREFIX) for c in name.split("/"))
    return {
        "archive": archive, "name": name + "/" * folder, "source": source, "is_directory": folder, "is_symlink": link and (top or not junk),
        "is_junk": junk and not (link and top), "modified": datetime.datetime.fromtimestamp(os.lstat(source).st_mtime), "entered": not folder,
    }


def _listing(whole: bool):
    """A ``mapInArrow`` function: every row, and what lies below folders not yet entered; only their children unless ``whole``."""
    kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.timestamp("us"), pa.bool_())
    schema = pa.schema(list(zip(("archive", "name", "source", "is_directory", "is_symlink", "is_junk", "modified", "entered"), kinds, strict=True)))

    def below(row: dict) -> Iterator[dict]:
        yield row | {"entered": True}
        stack = [] if row["entered"] else [row]
        while stack:
            folder = stack.pop()
            with os.scandir(folder["source"]) as children:
                for child in children:
                    found = _item(row["archive"], f"{folder['source']}/{child.name}", folder["name"] + child.name, False)
                    if whole and found["is_directory"]:
                        stack.append(found)
                    yield found | {"entered": whole or found["entered"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (found for batch in batches for row in batch.to_pylist() for found in below(row))
        while part := list(islice(rows, 4096)):
            yield pa.RecordBatch.from_pylist(part, schema)

    return run


def scan(spark: SparkSession, inputs: list[str], archive: str) -> DataFrame:
    """Every file and folder under the inputs, named from the input's own name on; links and metadata are marked.

    At the top a link counts as a link even if it is metadata, below it as
    metadata. Linked folders are not entered. The driver looks at the inputs
    only: tasks list their folders, then the folders in those, and then walk what is
    left, a subtree each.
    """
    for path in inputs:
        if not os.path.lexists(path):
            raise FileNotFoundError(path)
    places = [p.rstrip("/") for p in inputs]
    rows = [tuple(_item(archive, p, os.path.basename(p), True).values()) for p in places]
    wide = f"{ITEMS}, entered boolean"
    found = spark.createDataFrame(rows, wide)
    for whole in (False, False, True):
        found = found.repartition("source").mapInArrow(_listing(whole), wide)
    return found.drop("entered")


def _kept(found: DataFrame, clean: bool) -> DataFrame:
    kept = found.where(~F.col("is_symlink") & (~F.col("is_junk") | F.lit(not clean)))
    kept = kept.withColumn("entry_index", F.row_number().over(Window.partitionBy("archive").orderBy(N.nfc(F.col("name")))).cast("long") - 1)
    return kept.select("archive", "entry_index", "name", "source", "is_directory", A.dos_time(F.col("modified")).alias("dos_time"), A.dos_date(F.col("modified")).alias("dos_date"))


def pack_items(found: DataFrame, clean: bool = True) -> DataFrame:
    """Items of the sink from a scan: no links, no metadata if ``clean``, sorted by NFC name; contents are read by the tasks, whole."""
    schema = pa.schema([("archive", pa.string()), ("entry_index", pa.int64()), ("name", pa.string()), ("content", pa.binary()), ("dos_time", pa.int32()), ("dos_date", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                r["content"] = b""
                if not r["is_directory"]:
                    with open(r["source"], "rb") as f:
                        r["content"] = f.read()
                yield pa.RecordBatch.from_pylist([r], schema)

    return _kept(found, clean).mapInArrow(read, "archive string, entry_index long, name string, content binary, dos_time int, dos_date int")


def pack_blocks(found: DataFrame, clean: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Like :func:`pack_items`, with files in blocks for ``archives.write_blocks``; the first bytes decide whether a file is stored."""
    schema = pa.schema([("archive", pa.string()), ("entry_index", pa.int64()), ("block", pa.int64()), ("is_last", pa.bool_()), ("name", pa.string()), ("content", pa.binary()), ("dos_time", pa.int32()), ("dos_date", pa.int32()), ("stored", pa.bool_())])

    def blocks(r: dict) -> Iterator[dict]:
        if r["is_directory"]:
            yield r | {"block": 0, "is_last": True, "content": b"", "stored": True}
            return
        with open(r["source"], "rb") as f:
            body, n = f.read(block_bytes), 0
            stored = not archives.worthwhile(body)
            while True:
                after = f.read(block_bytes)
                yield r | {"block": n, "is_last": not after, "content": body, "stored": stored}
                if not after:
                    return
                body, n = after, n + 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for block in blocks(r):
                    yield pa.RecordBatch.from_pylist([block], schema)

    return _kept(found, clean).mapInArrow(read, "archive string, entry_index long, block long, is_last boolean, name string, content binary, dos_time int, dos_date int, stored boolean")


def _move_into(staging: str, destination: str) -> list[str]:
    """Move all top items of ``staging``; if one cannot be, those already moved go back."""
    tops = sorted(os.listdir(staging))
    for top in tops:
        if os.path.lexists(f"{destination}/{top}"):
            raise FileExistsError(f"{destination}/{top}")
    moved = []
    try:
        for top in tops:
            if os.path.lexists(f"{destination}/{top}"):
                raise FileExistsError(f"{destination}/{top}")
            os.rename(f"{staging}/{top}", f"{destination}/{top}")
            moved.append(top)
    except OSError:
        for top in moved:
            os.rename(f"{destination}/{top}", f"{staging}/{top}")
        raise
    return tops


def extract(contents: DataFrame, plan: DataFrame, destination: str) -> list[str]:
    """Write the planned entries below ``destination``, with their modes and times; the top items made.

    All entries go to a hidden staging folder first and move into place after
    the last one is written; an error removes the staging folder and what has
    been moved, and touches nothing else. Times without a zone are those of the
    machine; impossible ones stay the time of writing. ``contents`` has the
    planned entries as rows of ``archives.read_contents``, or of
    ``archives.read_chunks`` for files of any size.
    """
    staging = f"{destination}/.{uuid.uuid4().hex}.part"
    os.makedirs(staging)
    planned = plan.where(F.col("error_code").isNull())
    if "status" in contents.columns:
        failed = F.col("status") == "error"
        contents = contents.select("path", "entry_index", F.lit(0).alias("chunk_index"), "content", F.lit(True).alias("is_last"), F.when(failed, F.coalesce("error_code", F.lit("error"))).alias("failure"))
    else:
        contents = contents.withColumnRenamed("error_code", "failure")
    keys = ["path", "entry_index"]
    # folders may have no row of contents
    work = planned.join(contents, keys, "left").where("is_directory or chunk_index is not null")
    work = work.repartition(*keys).sortWithinPartitions(*keys, "chunk_index")

    def write(rows: Iterator[Row]) -> None:
        part, file = None, None
        for r in rows:
            if r.failure is not None:
                raise ValueError(f"{r.path}: {r.failure} in {r.target}")
            place = f"{staging}/{r.target}"
            if r.is_directory:
                os.makedirs(place, exist_ok=True)
                continue
            if r.chunk_index == 0:
                os.makedirs(os.path.dirname(place), exist_ok=True)
                part = f"{place}.{uuid.uuid4().hex}"
                file = open(part, "xb")  # a retried task writes anew and replaces its own file
            file.write(bytes(r.content))
            if not r.is_last:
                continue
            file.close()
            if r["mode"] is not None:
                os.chmod(part, r["mode"])
            if r.modified is not None:
                os.utime(part, (r.modified.timestamp(),) * 2)
            os.replace(part, place)

    def date_folders(rows: Iterator[Row]) -> None:
        for r in rows:
            os.utime(f"{staging}/{r.target}", (r.modified.timestamp(),) * 2)

    try:
        work.foreachPartition(write)
        # a folder's own time goes on when nothing is written into it any more
        planned.where("is_directory and modified is not null").select("target", "modified").foreachPartition(date_folders)
        return _move_into(staging, destination)
    finally:
        shutil.rmtree(staging, ignore_errors=True)
