"""Archive-wide operators over an entries DataFrame.

Entries have at least ``path`` (the archive), ``entry_index`` and ``name``; rows
carry no order of their own, so every order-dependent rule goes by
``entry_index``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coffer.functions import attributes as A
from coffer.functions import names as N

SATURATED = "18446744073709551615"


def saturating_total(size: Column) -> Column:
    """Sum of unsigned 64-bit sizes, held at 2**64 - 1; 0 for no rows."""
    return F.coalesce(F.least(F.sum(size.cast("decimal(20,0)")).cast("decimal(30,0)"), F.expr(f"cast({SATURATED} as decimal(30,0))")), F.lit(0).cast("decimal(30,0)"))


def with_verdicts(entries: DataFrame) -> DataFrame:
    """Adds is_directory, mode, is_symlink, is_junk, is_unsafe, utf8_flagged, encryption."""
    mode = A.unix_mode(F.col("version_made_by"), F.col("external_attributes"))
    return (
        entries.withColumn("is_directory", A.is_directory(F.col("name")))
        .withColumn("mode", mode)
        .withColumn("is_symlink", A.is_symlink(F.col("mode")))
        .withColumn("is_junk", N.is_junk(F.col("name")))
        .withColumn("is_unsafe", N.is_unsafe(F.col("name")))
        .withColumn("utf8_flagged", A.has_flag(F.col("flags"), A.UTF8_NAME))
        .withColumn("encryption", A.encryption_kind(F.col("flags"), F.col("method")))
    )


def inspect_summary(entries: DataFrame) -> DataFrame:
    """One row for each archive: counts, encryption kinds, declared total. Unsafe and symlink entries count independently."""
    kinds = F.array_sort(F.collect_set(F.when(F.col("encryption") != "none", F.lower("encryption"))))
    return with_verdicts(entries).groupBy("path").agg(
        F.count("*").alias("entries"),
        F.count_if("utf8_flagged").alias("utf8_flagged"),
        F.count_if("is_junk").alias("junk"),
        F.count_if("is_unsafe").alias("unsafe"),
        F.count_if("is_symlink").alias("symlinks"),
        F.count_if("is_directory").alias("directories"),
        F.when(F.size(kinds) == 0, "none").otherwise(F.array_join(kinds, ", ")).alias("encryption"),
        saturating_total(F.col("uncompressed_size")).cast("decimal(20,0)").alias("declared_total"),
    )


def inspect_entries(entries: DataFrame, bits: int = 256, vendor: int = 2) -> DataFrame:
    """Size, method, encryption label, name flag and name of each entry."""
    e = with_verdicts(entries)
    return e.select(
        "path", "entry_index", F.col("uncompressed_size").cast("decimal(20,0)").alias("size"), A.method_label(F.col("method")).alias("method"),
        A.encryption_label(F.col("encryption"), F.lit(bits), F.lit(vendor)).alias("encryption"),
        F.when(F.col("utf8_flagged"), "utf8").otherwise("-").alias("name_flag"), "name",
    )


def disposition(entries: DataFrame) -> DataFrame:
    """Adds ``disposition``: unsafe, then symlink, then keep; one ordered decision."""
    e = with_verdicts(entries)
    return e.withColumn("disposition", F.when(F.col("is_unsafe"), "unsafe").when(F.col("is_symlink"), "symlink").otherwise("keep"))


def skip_report(entries: DataFrame) -> DataFrame:
    """What unpacking would skip, by archive."""
    return disposition(entries).groupBy("path").agg(
        F.count_if(F.col("disposition") == "unsafe").alias("skipped_unsafe"),
        F.count_if(F.col("disposition") == "symlink").alias("skipped_symlinks"),
        F.count_if((F.col("disposition") == "keep") & F.col("is_directory")).alias("directories"),
        F.count_if((F.col("disposition") == "keep") & ~F.col("is_directory")).alias("files"),
    )


def writer_layout(entries: DataFrame) -> DataFrame:
    """Adds local_header_offset as a running sum over the archive; 30 fixed bytes, the name, the payload."""
    before = Window.partitionBy("path").orderBy("entry_index").rowsBetween(Window.unboundedPreceding, -1)
    span = (F.lit(30) + F.octet_length("name") + F.col("compressed_size")).cast("long")
    return entries.withColumn("local_header_offset", F.coalesce(F.sum(span).over(before), F.lit(0).cast("long")))


def archive_size(entries: DataFrame) -> DataFrame:
    """Bytes of a whole archive: local parts, central directory of 46 and the name, end record of 22."""
    name = F.octet_length("name").cast("long")
    return entries.groupBy("path").agg(
        F.count("*").alias("entries"),
        F.sum(F.lit(30) + name + F.col("compressed_size")).cast("long").alias("local_bytes"),
        F.sum(F.lit(46) + name).cast("long").alias("central_bytes"),
        F.sum(F.lit(76) + name * 2 + F.col("compressed_size") + 0).cast("long").alias("both"),
    ).select("path", "entries", "local_bytes", "central_bytes", (F.col("both") + 22).alias("archive_bytes"))


def overlap_check(entries: DataFrame, archive_length: Column | None = None) -> DataFrame:
    """(path, overlaps, past_end, error_code): byte ranges of files sorted by start; any that starts before its predecessor's end.

    Every range is longer than zero, so the neighbour decides.
    """
    files = entries.where(~A.is_directory(F.col("name")))
    start = F.col("local_header_offset").cast("decimal(20,0)")
    end = start.cast("decimal(30,0)") + 30 + F.octet_length("name") + F.col("compressed_size").cast("decimal(20,0)")
    ranges = files.select("path", "entry_index", start.alias("start"), end.alias("end"), (archive_length if archive_length is not None else F.lit(None).cast("long")).alias("length"))
    prior = F.lag("end").over(Window.partitionBy("path").orderBy("start", "end"))
    marked = ranges.withColumn("overlap", F.coalesce(F.col("start") < prior, F.lit(False))).withColumn("past", F.coalesce(F.col("end") > F.col("length"), F.lit(False)))
    found = marked.groupBy("path").agg(F.count_if("overlap").alias("overlaps"), F.count_if("past").alias("past_end"))
    return found.withColumn("error_code", F.when(F.col("past_end") > 0, "corrupt").when(F.col("overlaps") > 0, "overlappingEntries"))


def duplicate_names(entries: DataFrame) -> DataFrame:
    """(path, name, copies) of names whose encoded bytes occur more than once; a writer refuses them."""
    return entries.groupBy("path", "name").agg(F.count("*").alias("copies")).where("copies > 1")


def wrapper_policy(entries: DataFrame) -> DataFrame:
    """(path, top_names, wrap): whether the content goes into a folder of its own."""
    kept = disposition(entries).where(F.col("disposition") == "keep")
    top = N.nfc(N.safe_components(F.col("name"))[0])
    return kept.groupBy("path").agg(F.count_distinct(top).alias("top_names")).withColumn("wrap", F.col("top_names") > 1)


def implicit_directories(paths: DataFrame) -> DataFrame:
    """(path, directory): every folder that the files of an archive bring into being."""
    parts = N.safe_components(F.col("name"))
    folders = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice(F.col("parts"), F.lit(1), i), "/"))
    rows = paths.withColumn("parts", parts).where(F.col("parts").isNotNull() & (F.size("parts") > 1))
    return rows.select("path", F.explode(folders).alias("directory")).distinct()


def sorted_index(items: DataFrame) -> DataFrame:
    """Pack order: entries sorted by NFC name, numbered from 0 within the archive."""
    order = Window.partitionBy("path").orderBy(N.nfc(F.col("name")))
    return items.withColumn("entry_index", (F.row_number().over(order) - 1).cast("long"))


def refusals(entries: DataFrame, free_bytes: Column, password: bool = False, margin: int = 64 << 20) -> DataFrame:
    """(path, required, budget, error_code): nothing to write, then a password, then space; null if extraction may start.

    Skipped entries count toward the required bytes; unknown free space is not judged.
    """
    e = disposition(entries)
    keep = F.col("disposition") == "keep"
    found = e.groupBy("path").agg(
        F.count_if(keep).alias("work"),
        F.coalesce(F.bool_or(keep & ~F.col("is_directory") & (F.col("encryption") != "none")), F.lit(False)).alias("locked"),
        saturating_total(F.col("uncompressed_size")).cast("decimal(20,0)").alias("required"),
    )
    found = found.withColumn("free", free_bytes).withColumn("budget", F.when(F.col("free").isNotNull(), F.greatest(F.col("free") - margin, F.lit(0).cast("long"))))
    code = F.when(F.col("work") == 0, "emptyArchive").when(F.col("locked") & F.lit(not password), "passwordRequired").when(F.col("required") > F.col("budget"), "insufficientSpace")
    return found.select("path", "required", "budget", code.alias("error_code"))


def progress(entries: DataFrame) -> DataFrame:
    """Adds processed, total and permille after each entry, in archive order; capped at 1000, and 0 where the total is 0."""
    upto = Window.partitionBy("path").orderBy("entry_index").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("uncompressed_size").cast("long")
    e = entries.withColumn("processed", F.sum(size).over(upto)).withColumn("total", F.sum(size).over(Window.partitionBy("path")))
    return e.withColumn("permille", F.when(F.col("total") == 0, 0).otherwise(F.least(F.floor(F.col("processed") * 1000 / F.col("total")), F.lit(1000))).cast("long"))


def detected_encoding(entries: DataFrame) -> DataFrame:
    """(path, detected_encoding): utf8 unless some unflagged non-ASCII raw name is not valid UTF-8."""
    text = F.col("raw_name").cast("string")
    plain = F.rlike(F.hex("raw_name"), F.lit("^(?:[0-7][0-9A-F])*+$"))
    odd = ~A.has_flag(F.col("flags"), A.UTF8_NAME) & ~plain
    fits = F.bool_and(F.when(odd, F.is_valid_utf8(text)))
    return entries.groupBy("path").agg(F.when(F.coalesce(fits, F.lit(True)), "utf8").otherwise("cp932").alias("detected_encoding"))


def decoded_names(entries: DataFrame, forced: str | None = None) -> DataFrame:
    """Adds ``name``: UTF-8 where flagged, else the archive's encoding with the other and Latin-1 as fallbacks."""
    raw = F.col("raw_name")
    as_utf8 = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    latin = F.decode(raw, "ISO-8859-1")
    e = entries.withColumn("detected_encoding", F.lit(forced)) if forced else entries.join(detected_encoding(entries), "path")
    usual = F.when(F.col("detected_encoding") == "utf8", F.coalesce(as_utf8, N.cp932_decode(raw), latin)).otherwise(F.coalesce(N.cp932_decode(raw), as_utf8, latin))
    return e.withColumn("name", F.when(A.has_flag(F.col("flags"), A.UTF8_NAME), F.coalesce(as_utf8, latin)).otherwise(usual))
