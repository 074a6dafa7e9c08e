"""Packing a folder and unpacking it again, with the refusals in between."""

import datetime
import os
import zipfile

import pytest
from pyspark.sql import functions as F

import zips
from coffer.operators import listing, unpacking
from coffer.sources import archives, trees


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "sub" / "empty").mkdir(parents=True)
    (root / "__MACOSX").mkdir()
    for name, text in {"a.txt": "a" * 500, "sub/データ.csv": "月,売上\n", ".DS_Store": "x", "__MACOSX/y": "y"}.items():
        (root / name).write_text(text)
    os.symlink("a.txt", root / "link")
    return root


def decoded(spark, path):
    entries = spark.read.format("zip_entries").load(str(path))
    return listing.decoded_names(entries).withColumn("method", F.col("method_raw"))


def test_pack_and_unpack(spark, tmp_path, folder):
    archives.register(spark)
    found = trees.scan(spark, [str(folder)], "docs.zip")
    assert {r.name for r in found.where("is_symlink").collect()} == {"docs/link"}
    archives.write_archives(trees.pack_items(found), str(tmp_path / "out"))
    listed = zipfile.ZipFile(tmp_path / "out" / "docs.zip").namelist()
    assert listed == sorted(listed) == ["docs/", "docs/a.txt", "docs/sub/", "docs/sub/empty/", "docs/sub/データ.csv"]
    entries = decoded(spark, tmp_path / "out")
    target = tmp_path / "here"
    (target / "docs").mkdir(parents=True)
    existing = spark.createDataFrame([("docs",)], "name string")
    plan = unpacking.plan(entries, existing, F.lit(1 << 40).cast("long"))
    assert trees.extract(archives.read_contents(entries), plan, str(target)) == ["docs 2"]
    assert (target / "docs 2" / "sub" / "データ.csv").read_text() == "月,売上\n" and (target / "docs 2" / "sub" / "empty").is_dir()
    assert sorted(os.listdir(target)) == ["docs", "docs 2"] and not os.listdir(target / "docs")
    with pytest.raises(FileNotFoundError):
        trees.scan(spark, [str(tmp_path / "none")], "x.zip")


def test_plan_wraps_renames_and_refuses(spark, tmp_path):
    archives.register(spark)
    files = {
        "many.zip": [(b"a.txt", b"1"), (b"b.txt", b"2"), (b"A.TXT", b"3"), (b"../evil", b"4")],
        "one.zip": [(b"a.txt", b"1")],
        "evil.zip": [(b"/etc/passwd", b"1")],
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(zips.archive(content))
    entries = decoded(spark, tmp_path)
    nothing = spark.createDataFrame([], "name string")
    rows = unpacking.plan(entries, nothing, F.lit(1 << 40).cast("long")).collect()
    assert {r.target for r in rows if r.target} == {"many/a.txt", "many/b.txt", "many/A 2.TXT", "a.txt"}
    assert {os.path.basename(r.path): r.error_code for r in rows if r.error_code} == {"evil.zip": "emptyArchive"}
    never = unpacking.plan(entries, nothing, F.lit(1 << 40).cast("long"), policy="never").collect()
    assert sorted(r.target for r in never if r.target) == ["A 2.TXT", "a 2.txt", "a.txt", "b.txt"]
    full = unpacking.plan(entries, nothing, F.lit(1).cast("long")).collect()
    assert {r.error_code for r in full} == {"emptyArchive", "insufficientSpace"}
    with pytest.raises(ValueError):
        unpacking.plan(entries, nothing, F.lit(1).cast("long"), policy="sometimes")


def test_failed_extraction_leaves_nothing(spark, tmp_path):
    archives.register(spark)
    (tmp_path / "bomb.zip").write_bytes(zips.size_lie())
    entries = decoded(spark, tmp_path)
    target = tmp_path / "here"
    target.mkdir()
    plan = unpacking.plan(entries, spark.createDataFrame([], "name string"), F.lit(1 << 40).cast("long"))
    with pytest.raises(Exception, match="sizeExceedsDeclared"):
        trees.extract(archives.read_contents(entries), plan, str(target))
    assert not os.listdir(target)


def test_extraction_keeps_times(spark, tmp_path):
    archives.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "sub" / "a.txt").write_text("text")
    stamp = datetime.datetime(2021, 3, 4, 5, 6, 8).timestamp()
    for place in ("in/sub/a.txt", "in/sub", "in"):
        os.utime(tmp_path / place, (stamp, stamp))
    (tmp_path / "zips").mkdir()
    archives.write_archives(trees.pack_items(trees.scan(spark, [str(tmp_path / "in")], "x.zip")), str(tmp_path / "zips"))
    entries = decoded(spark, tmp_path / "zips")
    out = tmp_path / "out"
    out.mkdir()
    plan = unpacking.plan(entries, spark.createDataFrame([], "name string"), F.lit(1 << 40).cast("long"))
    assert trees.extract(archives.read_contents(entries), plan, str(out)) == ["in"]
    assert {os.stat(out / place).st_mtime for place in ("in/sub/a.txt", "in/sub", "in")} == {stamp}


def test_moves_are_undone(tmp_path, monkeypatch):
    staging, out = tmp_path / "staging", tmp_path / "out"
    for folder in (staging, out, staging / "a", staging / "b"):
        folder.mkdir()
    (out / "b").mkdir()
    with pytest.raises(FileExistsError):
        trees._move_into(str(staging), str(out))
    assert sorted(os.listdir(out)) == ["b"] and sorted(os.listdir(staging)) == ["a", "b"]
    (out / "b").rmdir()
    rename = os.rename

    def failing(source, target):
        if source.endswith("staging/b"):
            raise OSError("no room")
        rename(source, target)

    monkeypatch.setattr(trees.os, "rename", failing)
    with pytest.raises(OSError, match="no room"):
        trees._move_into(str(staging), str(out))
    assert os.listdir(out) == [] and sorted(os.listdir(staging)) == ["a", "b"]


def test_routing(spark):
    df = spark.createDataFrame([(1, "a.zip"), (1, "b.ZIP"), (2, "a.zip"), (2, "c.txt"), (3, "dir/report.pdf")], "request int, path string")
    assert {r.request: r.unpack for r in unpacking.wants_unpacking(df).collect()} == {1: True, 2: False, 3: False}
    assert {r.request: r.output for r in unpacking.default_output(df).collect()} == {1: "Archive.zip", 2: "Archive.zip", 3: "report.zip"}


def test_blocks_and_chunks_through_a_tree(spark, tmp_path):
    archives.register(spark)
    root = tmp_path / "in"
    (root / "a" / "b" / "c" / "d").mkdir(parents=True)
    content = {"a/b/c/d/deep.txt": b"line of text\n" * 9000, "a/noise.bin": os.urandom(70000), "top.txt": b"x", "none": b""}
    for name, body in content.items():
        (root / name).write_bytes(body)
    (tmp_path / "zips").mkdir()
    found = trees.scan(spark, [str(root)], "x.zip")
    assert {r.name for r in found.collect()} == {"in/", "in/a/", "in/a/b/", "in/a/b/c/", "in/a/b/c/d/"} | {f"in/{n}" for n in content}
    archives.write_blocks(trees.pack_blocks(found, block_bytes=16384), str(tmp_path / "zips"))
    with zipfile.ZipFile(tmp_path / "zips" / "x.zip") as z:
        assert z.testzip() is None and {n: z.read(f"in/{n}") for n in content} == content
        assert z.getinfo("in/a/noise.bin").compress_type == 0 and z.getinfo("in/a/b/c/d/deep.txt").compress_type == 8
    entries = decoded(spark, tmp_path / "zips")
    out = tmp_path / "out"
    out.mkdir()
    plan = unpacking.plan(entries, spark.createDataFrame([], "name string"), F.lit(1 << 40).cast("long"))
    assert trees.extract(archives.read_chunks(entries, chunk_bytes=10000), plan, str(out)) == ["in"]
    assert {n: (out / "in" / n).read_bytes() for n in content} == content
