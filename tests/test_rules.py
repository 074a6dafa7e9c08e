"""Names, attributes and archive rules against the published vectors."""

import datetime

import pytest
from pyspark.sql import functions as F

from coffer.functions import attributes as A
from coffer.functions import names as N
from coffer.operators import batch, listing, numbering


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_junk(spark):
    yes = [".DS_Store", "a/.DS_Store", "__MACOSX/a", "Icon\r", "x/._y", ".fseventsd", ".Spotlight-V100/z", ".Trashes"]
    no = ["DS_Store", "Icon", "my.DS_Store.bak", "report._final.pdf", ".ds_store", ""]
    assert values(spark, N.is_junk, yes + no) == [True] * len(yes) + [False] * len(no)


def test_sanitize(spark):
    bad = ["../evil.txt", "docs/../../evil.txt", "/etc/passwd", "C:\\Windows\\evil.txt", "file.txt:stream", "", ".", "./", "\\x", "..\\x"]
    good = {"./docs/a.txt": ["docs", "a.txt"], "docs\\sub\\a.txt": ["docs", "sub", "a.txt"], "a//b/": ["a", "b"], "...": ["..."]}
    assert values(spark, N.safe_components, [*bad, *good, None]) == [None] * len(bad) + list(good.values()) + [None]


def test_unicode_and_code_page(spark):
    assert values(spark, N.nfc, ["\u30db\u309a", "abc", None]) == ["\u30dd", "abc", None]
    assert values(spark, N.cp932_encode, ["①㈱", "😀", None]) == ["①㈱".encode("cp932"), None, None]
    assert values(spark, N.cp932_decode, ["日本語".encode("cp932"), b"\x93", None], "binary") == ["日本語", None, None]


def test_numbering_of_a_name(spark):
    got = values(spark, lambda c: N.numbered(c, F.lit(2)), ["report.pdf", "name", ".bashrc", "a.tar.gz", "v1. draft"])
    assert got == ["report 2.pdf", "name 2", ".bashrc 2", "a.tar 2.gz", "v1. draft 2"]
    assert [numbering.numbered_name(x, 2) for x in ("report.pdf", "name", ".bashrc", "a.tar.gz", "v1. draft")] == got


def test_modes(spark):
    got = values(spark, lambda c: A.extracted_mode(c, F.lit(False)), [0o777, 0o666, 0o4777, 0, None], "int")
    assert got == [0o755, 0o644, 0o755, 0o600, None]
    assert values(spark, lambda c: A.extracted_mode(c, F.lit(True)), [0o555], "int") == [0o755]
    made = spark.createDataFrame([(788, 0o120777 << 16), (20, 0o120777 << 16), (19 << 8, 0), (788, 0o100644 << 16)], "made int, attributes long")
    mode = A.unix_mode(F.col("made"), F.col("attributes"))
    assert [(r[0], r[1]) for r in made.select(mode, A.is_symlink(mode)).collect()] == [(0o120777, True), (None, False), (None, False), (0o100644, False)]


def test_dos_times(spark):
    stamps = [datetime.datetime(2024, 2, 29, 14, 30, 23), datetime.datetime(1970, 5, 6), datetime.datetime(2200, 1, 1)]
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
    got = [r[0] for r in df.select(A.from_dos(A.dos_date(F.col("ts")), A.dos_time(F.col("ts")))).collect()]
    assert got == [datetime.datetime(2024, 2, 29, 14, 30, 22), datetime.datetime(1980, 5, 6), datetime.datetime(2107, 1, 1)]
    odd = spark.createDataFrame([(0, 0)], "d int, t int").select(A.from_dos(F.col("d"), F.col("t")))
    assert odd.first()[0] is None


def test_crc(spark):
    assert values(spark, lambda c: F.crc32(c.cast("binary")), ["123456789", "", "The quick brown fox jumps over the lazy dog"]) == [0xCBF43926, 0, 0x414FA339]


def test_cascading_duplicates(spark):
    rows = [("z", 0, "report.txt"), ("z", 1, "report.txt"), ("z", 2, "REPORT.TXT"), ("z", 3, "デ".encode().decode() + "ータ.txt"), ("z", 4, "\u30c6\u3099ータ.txt"), ("y", 0, "a"), ("y", 1, "a"), ("y", 2, "a 2"), ("y", 3, "d/"), ("y", 4, "d/"), ("y", 5, "d/a")]
    df = spark.createDataFrame(rows, "path string, entry_index int, name string")
    got = {(r.path, r.entry_index): r.chosen for r in numbering.number_duplicates(df).collect()}
    assert got["z", 0] == "report.txt" and got["z", 1] == "report 2.txt" and got["z", 2] == "REPORT 3.TXT"
    assert got["z", 3] == "データ.txt" and got["z", 4] == "\u30c6\u3099ータ 2.txt"
    assert [got["y", i] for i in (0, 1, 2, 5)] == ["a", "a 2", "a 2 2", "d/a"]
    assert ("y", 3) not in got


def test_top_level_renames(spark):
    tops = spark.createDataFrame([("p", "docs"), ("p", "docs 2"), ("p", "x")], "path string, top string")
    existing = spark.createDataFrame([("docs",)], "name string")
    got = {r.top: r.final for r in numbering.top_level_renames(tops, existing).collect()}
    assert got == {"docs": "docs 2", "docs 2": "docs 2 2", "x": "x"}


def entries(spark, rows):
    """rows: (path, index, name, flags, method, size)"""
    df = spark.createDataFrame(rows, "path string, entry_index int, name string, flags int, method int, uncompressed_size decimal(20,0)")
    return df.withColumn("version_made_by", F.lit(788)).withColumn("external_attributes", F.lit(0o100644 << 16).cast("long")).withColumn("compressed_size", F.col("uncompressed_size"))


def test_refusals_in_order(spark):
    from decimal import Decimal as D

    rows = [("empty", 0, "../x", 0, 8, D(1)), ("locked", 0, "a", 1, 99, D(2**63)), ("huge", 0, "a", 0, 8, D(2**63)), ("huge", 1, "b", 0, 8, D(2**63)), ("fine", 0, "a", 0, 8, D(1))]
    got = {r.path: (r.error_code, int(r.required)) for r in listing.refusals(entries(spark, rows), F.lit(1 << 30).cast("long")).collect()}
    assert got == {"empty": ("emptyArchive", 1), "locked": ("passwordRequired", 2**63), "huge": ("insufficientSpace", 2**64 - 1), "fine": (None, 1)}
    assert {r.path: r.error_code for r in listing.refusals(entries(spark, rows), F.lit(None).cast("long"), password=True).collect()}["huge"] is None


def test_overlaps(spark):
    from decimal import Decimal as D

    df = entries(spark, [("p", i, f"f{i}", 0, 0, D(10)) for i in range(3)])
    laid = listing.writer_layout(df)
    assert listing.overlap_check(laid).first().error_code is None
    same = laid.withColumn("local_header_offset", F.lit(0))
    assert listing.overlap_check(same).first().error_code == "overlappingEntries"
    assert listing.overlap_check(laid, F.lit(50)).first().error_code == "corrupt"


def test_empty_frames(spark):
    nothing = entries(spark, [])
    for made in (listing.inspect_summary, listing.skip_report, listing.archive_size, listing.wrapper_policy, numbering.number_duplicates):
        assert made(nothing).count() == 0


@pytest.mark.parametrize("failures", [0, 9])
def test_batch_notes_state_what_they_cut(spark, failures):
    rows = [("b", i, i < failures, 1, 0, 0, None) for i in range(12)]
    df = spark.createDataFrame(rows, "batch string, archive int, failed boolean, files int, directories int, symlinks int, unsafe string")
    notes = batch.batch_notes(df).collect()
    assert [(n.shown, n.more) for n in notes] == ([("0; 1; 2; 3; 4; 5", 3)] if failures else [])
    assert batch.batch_summary(df).first().succeeded == 12 - failures


def test_batch_progress_of_empty_archives(spark):
    df = spark.createDataFrame([("b", i, 0) for i in range(4)], "batch string, archive int, size long")
    assert [r.permille for r in batch.batch_progress(df).orderBy("archive").collect()] == [0, 250, 500, 750]
