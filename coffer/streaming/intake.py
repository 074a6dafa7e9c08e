"""Archives that arrive in a folder, taken in as a stream."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.sources import zipfile_format as Z

LISTED = "path string, entries int, declared_total decimal(20,0), error_code string"


def archive_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New ``*.zip`` files of ``folder`` as (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.zip").load(folder)


def listed(archives: DataFrame) -> DataFrame:
    """(path, entries, declared_total, error_code) of each archive; a refused one does not stop the others."""
    from decimal import Decimal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("entries", pa.int32()), ("declared_total", pa.decimal128(20, 0)), ("error_code", pa.string())])
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = {"path": path, "entries": None, "declared_total": None, "error_code": None}
                try:
                    found = Z.read_directory(io.BytesIO(content), len(content))
                    total = min(sum(e["uncompressed_size"] for e in found), 2**64 - 1)
                    row |= {"entries": len(found), "declared_total": Decimal(total)}
                except Z.ZipError as e:
                    row["error_code"] = e.code
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)

    return archives.select("path", F.col("content")).mapInArrow(run, LISTED)


def take_in(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Run ``handle`` on the listing of all archives not yet seen, once each, then stop."""
    query = listed(archive_stream(spark, folder)).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
