"""Batch reporting over per-archive outcomes (batch, archive, failed, files, directories, symlinks, unsafe)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines that a note shows before it says how many more there are.
NOTE_LINES = 6


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """Totals of each batch; failed archives count as requested only."""
    done = ~F.col("failed")

    def total(name: str):
        return F.coalesce(F.sum(F.when(done, F.col(name))), F.lit(0)).cast("long").alias(name)

    succeeded = F.count_if(done)
    return outcomes.groupBy("batch").agg(
        F.count("*").alias("requested"), succeeded.alias("succeeded"), F.count_if("failed").alias("failures"), total("files"), total("directories"), total("symlinks"),
        (succeeded == 0).alias("total_failure"),
    )


def batch_notes(outcomes: DataFrame, lines: int = NOTE_LINES) -> DataFrame:
    """(batch, note, shown, more): the first lines of each note, and how many are left.

    Lines are ranked before they are gathered, so no more than ``lines`` of a
    note meet in one row.
    """
    failures = outcomes.where("failed").select("batch", F.lit("failed").alias("note"), "archive", F.col("archive").cast("string").alias("line"))
    unsafe = outcomes.where(~F.col("failed") & F.col("unsafe").isNotNull()).select("batch", F.lit("unsafe").alias("note"), "archive", F.col("unsafe").alias("line"))
    rows = failures.unionByName(unsafe)
    counts = rows.groupBy("batch", "note").agg(F.count("*").alias("n"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("batch", "note").orderBy("archive"))).where(F.col("rank") <= lines)
    shown = ranked.groupBy("batch", "note").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x.line), "; ").alias("shown"))
    return shown.join(counts, ["batch", "note"]).select("batch", "note", "shown", F.greatest(F.col("n") - lines, F.lit(0).cast("long")).alias("more"))


def batch_progress(archives: DataFrame) -> DataFrame:
    """(batch, archive, before, total, permille): share of the batch done before each archive starts; archives weigh alike if all are empty."""
    every = Window.partitionBy("batch")
    before = every.orderBy("archive").rowsBetween(Window.unboundedPreceding, -1)
    weighed = archives.withColumn("weight", F.when(F.sum("size").over(every) > 0, F.col("size")).otherwise(1).cast("long"))
    rows = weighed.withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0).cast("long"))).withColumn("total", F.sum("weight").over(every))
    return rows.select("batch", "archive", "before", "total", F.floor(F.col("before") * 1000 / F.col("total")).cast("long").alias("permille"))
