"""What unpacking an archive would write, and whether it may: the rules put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.functions import attributes as A
from coffer.functions import names as N
from coffer.operators import listing, numbering

#: Whether content goes into a folder named after its archive.
POLICIES = ("always", "never", "onlyMultipleTopLevel")


def wants_unpacking(inputs: DataFrame) -> DataFrame:
    """(request, unpack): a request of (request, path) rows is to unpack if all its files are .zip, else to pack them."""
    return inputs.groupBy("request").agg(F.bool_and(F.lower(N.extension(N.leaf(F.col("path")))) == "zip").alias("unpack"))


def default_output(inputs: DataFrame) -> DataFrame:
    """(request, output): the single input's stem, or "Archive", with .zip."""
    one = F.concat(N.stem(N.leaf(F.regexp_replace("path", "/+$", ""))), F.lit(".zip"))
    return inputs.groupBy("request").agg(F.when(F.count("*") == 1, F.first(one)).otherwise("Archive.zip").alias("output"))


def plan(entries: DataFrame, existing: DataFrame, free_bytes: Column, policy: str = "onlyMultipleTopLevel", password: bool = False, umask: int = 0o022) -> DataFrame:
    """(path, entry_index, target, is_directory, mode, modified, error_code) of everything an extraction would write.

    ``entries`` need name, flags, method, sizes and attributes, and have dos_time
    and dos_date where times are to be kept; ``existing`` (name) lists the
    destination. A refused archive gives one row with its
    error_code and no target. Targets are unique and never name anything that
    exists; the wrapper is named after the archive.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    kept = listing.disposition(entries).where(F.col("disposition") == "keep")
    safe = F.concat(N.safe_path(F.col("name")), F.when(F.col("is_directory"), "/").otherwise(""))
    kept = kept.withColumn("safe", safe)
    verdicts = listing.refusals(entries, free_bytes, password)
    refused = verdicts.where(F.col("error_code").isNotNull())
    kept = kept.join(refused.select("path"), "path", "left_anti")

    files = numbering.number_duplicates(kept.select("path", "entry_index", F.col("safe").alias("name")))
    named = kept.join(files.select("path", "entry_index", "chosen"), ["path", "entry_index"], "left").withColumn("inner", F.coalesce("chosen", "safe"))
    top = F.split("inner", "/")[0]
    tops = named.select("path", N.nfc(top).alias("top")).distinct()
    count = tops.groupBy("path").agg(F.count("*").alias("tops"))
    wrap = {"always": F.lit(True), "never": F.lit(False)}.get(policy, F.col("tops") > 1)
    named = named.withColumn("top", N.nfc(top)).join(count, "path").withColumn("wrap", wrap)

    wrapper = F.coalesce(F.nullif(N.stem(N.leaf(F.col("path"))), F.lit("")), F.lit("Archive"))
    wrapped = named.where("wrap").select("path").distinct().withColumn("top", wrapper)
    # archives of one request share the destination, so their top names are made unique together
    wanted = wrapped.unionByName(named.where("not wrap").select("path", "top").distinct())
    final = numbering.shared_renames(wanted, existing)
    placed = named.withColumn("top", F.when(F.col("wrap"), wrapper).otherwise(F.col("top"))).join(final, ["path", "top"])
    rest = F.expr("substring(inner, length(split(inner, '/')[0]) + 1)")
    target = F.when(F.col("wrap"), F.concat("final", F.lit("/"), "inner")).otherwise(F.concat("final", rest))
    mode = A.extracted_mode(F.col("mode"), F.col("is_directory"), umask)
    timed = {"dos_time", "dos_date"} <= set(entries.columns)
    modified = A.from_dos(F.col("dos_date"), F.col("dos_time")) if timed else F.lit(None).cast("timestamp_ntz")
    work = placed.select("path", "entry_index", F.regexp_replace(target, "/$", "").alias("target"), "is_directory", mode.alias("mode"), modified.alias("modified"), F.lit(None).cast("string").alias("error_code"))
    empty = refused.select("path", F.lit(None).cast(dict(work.dtypes)["entry_index"]).alias("entry_index"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("boolean").alias("is_directory"), F.lit(None).cast("int").alias("mode"), F.lit(None).cast("timestamp_ntz").alias("modified"), "error_code")
    return work.unionByName(empty)
