"""Reading and writing archive files."""

import io
import os
import struct
import tracemalloc
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import zips
from coffer.operators import listing
from coffer.sources import archives, ciphers
from coffer.sources import zipfile_format as Z
from coffer.streaming import intake


def directory(data):
    return Z.read_directory(io.BytesIO(data), len(data))


@pytest.mark.parametrize("data, code", [(zips.overlap(), "overlappingEntries"), (zips.truncated(), "corrupt"), (zips.locator_underflow(), "corrupt"), (zips.zip64_overflow(), "corrupt"), (b"not a zip at all, but long enough", "notAZipFile"), (b"", "notAZipFile")])
def test_refused_at_open(data, code):
    with pytest.raises(Z.ZipError) as e:
        directory(data)
    assert e.value.code == code


def test_size_lie_stops_early():
    data = zips.size_lie()
    with pytest.raises(Z.ZipError) as e:
        archives.entry_content(io.BytesIO(data), directory(data)[0], None)
    assert e.value.code == "sizeExceedsDeclared"


def test_crc_mismatch_and_method():
    data = zips.archive([(b"a.txt", b"hello")])
    e = directory(data)[0]
    with pytest.raises(Z.ZipError, match="crcMismatch"):
        archives.entry_content(io.BytesIO(data), e | {"crc32": 1}, None)
    with pytest.raises(Z.ZipError, match="unsupportedMethod"):
        archives.entry_content(io.BytesIO(data), e | {"method_raw": 12}, None)


def test_aes_published_vector():
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert ciphers.aes_blocks(key, np.frombuffer(plain, np.uint8).reshape(1, 16)).tobytes().hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert ciphers.aes_blocks(bytes(range(32)), np.frombuffer(plain, np.uint8).reshape(1, 16)).tobytes().hex() == "8ea2b7ca516745bfeafc49904b496089"


def test_traditional_cipher_against_the_standard_library():
    body = b"plain ascii content\n" * 9
    crc = zlib.crc32(body)
    sealed = ciphers.zipcrypto_sealed(body, "s3cret-pass", crc >> 24)
    made = zips.local(b"a.txt", sealed, flags=1, crc=crc, full=len(body))
    listed = zips.central(b"a.txt", len(sealed), len(body), crc, 0, flags=1)
    data = made + listed + zips.end(1, len(listed), len(made))
    assert zipfile.ZipFile(io.BytesIO(data)).read("a.txt", b"s3cret-pass") == body
    e = directory(data)[0]
    assert archives.entry_content(io.BytesIO(data), e, "s3cret-pass")[0] == body
    with pytest.raises(Z.ZipError) as error:
        archives.entry_content(io.BytesIO(data), e, None)
    assert error.value.code == "passwordRequired"
    with pytest.raises(Z.ZipError) as error:
        archives.entry_content(io.BytesIO(data), e, "wrong")
    assert error.value.code in ("wrongPassword", "crcMismatch")


def test_aes_tampering_is_seen():
    payload, extra = ciphers.aes_sealed(b"x" * 50, "pw", 0)
    for at, code in ((20, "authenticationFailed"), (0, "wrongPassword")):
        bad = bytearray(payload)
        bad[at] ^= 1
        chunks = lambda start, left, bad=bad: iter([bytes(bad[start : start + left])])
        with pytest.raises(Z.ZipError) as e:
            list(ciphers.aes_opened(chunks, 0, len(bad), "pw", 32))
        assert e.value.code == code


def items(spark, rows):
    df = spark.createDataFrame(rows, "archive string, entry_index int, name string, content binary")
    return df.withColumn("dos_time", F.lit(0x6F3C)).withColumn("dos_date", F.lit(0x5B01))


ROWS = [("a.zip", 0, "日本語ファイル.txt", "こんにちは\n".encode()), ("a.zip", 1, "readme.txt", b"plain ascii content\n" * 200), ("a.zip", 2, "dir/", b""), ("a.zip", 3, ".DS_Store", b"junk"), ("b.zip", 0, "x.jpg", b"z" * 1000), ("b.zip", 1, "noise.bin", os.urandom(5000))]


@pytest.mark.parametrize("password", [None, "s3cret-pass"])
def test_round_trip(spark, tmp_path, password):
    archives.register(spark)
    folder = str(tmp_path / "out")
    archives.write_archives(items(spark, ROWS), folder, password)
    assert sorted(os.listdir(folder)) == ["a.zip", "b.zip"]
    entries = spark.read.format("zip_entries").load(folder)
    got = archives.read_contents(entries, password).join(listing.decoded_names(entries).select("path", "entry_index", "name", "method_raw", "flags"), ["path", "entry_index"]).collect()
    by = {r.name: r for r in got}
    assert {n: bytes(r.content) for n, r in by.items() if r.status == "ok"} == {n: c for _, _, n, c in ROWS if n not in (".DS_Store", "dir/")}
    assert by["dir/"].status == "directory"
    if password is None:
        assert (by["readme.txt"].method_raw, by["x.jpg"].method_raw, by["noise.bin"].method_raw) == (8, 0, 0)
        with zipfile.ZipFile(f"{folder}/a.zip") as z:  # an independent reader
            assert z.testzip() is None and z.read("日本語ファイル.txt").decode() == "こんにちは\n"
            assert z.namelist() == ["日本語ファイル.txt", "readme.txt", "dir/"]
    else:
        assert {r.error_code for r in archives.read_contents(entries, "nope").collect()} <= {"wrongPassword", None, "authenticationFailed"}
        assert {r.error_code for r in archives.read_contents(entries).collect()} == {"passwordRequired", None}


def test_existing_archives_are_not_touched(spark, tmp_path):
    archives.register(spark)
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "b.zip").write_bytes(b"mine")
    with pytest.raises(Exception, match="exists|FileExists"):
        archives.write_archives(items(spark, ROWS), str(folder))
    assert sorted(os.listdir(folder)) == ["b.zip"] and (folder / "b.zip").read_bytes() == b"mine"
    archives.write_archives(items(spark, ROWS), str(folder), overwrite=True)
    assert zipfile.ZipFile(folder / "b.zip").testzip() is None


def test_duplicate_encoded_names_are_refused(spark, tmp_path):
    archives.register(spark)
    with pytest.raises(Exception, match="twice"):
        archives.write_archives(items(spark, [("a.zip", 0, "x", b"1"), ("a.zip", 1, "x", b"2")]), str(tmp_path / "out"))
    assert not os.listdir(tmp_path / "out")


def test_permissive_scan(spark, tmp_path):
    archives.register(spark)
    (tmp_path / "bad.zip").write_bytes(zips.overlap())
    (tmp_path / "good.zip").write_bytes(zips.archive([(b"a", b"1")]))
    (tmp_path / "wrap.zip").write_bytes(zips.declared_wrap())
    got = {os.path.basename(r.path): r for r in spark.read.format("zip_entries").option("mode", "PERMISSIVE").load(str(tmp_path)).groupBy("path").agg(F.count("entry_index").alias("n"), F.max("error_code").alias("code"), listing.saturating_total(F.col("uncompressed_size")).alias("total")).collect()}
    assert (got["bad.zip"].n, got["bad.zip"].code) == (0, "overlappingEntries")
    assert (got["good.zip"].n, got["good.zip"].code) == (1, None)
    assert int(got["wrap.zip"].total) == 2**64 - 1
    with pytest.raises(Exception, match="overlappingEntries"):
        spark.read.format("zip_entries").load(str(tmp_path)).count()


def test_code_page_archive(spark, tmp_path):
    archives.register(spark)
    (tmp_path / "c.zip").write_bytes(zips.archive([("日本語.txt".encode("cp932"), b"1"), ("フォルダ/データ.csv".encode("cp932"), b"2")]))
    got = listing.decoded_names(spark.read.format("zip_entries").load(str(tmp_path))).collect()
    assert {(r.detected_encoding, r.name) for r in got} == {("cp932", "日本語.txt"), ("cp932", "フォルダ/データ.csv")}


def test_wide_records():
    head = Z.local_header(b"n", 0, 0, 0, 0, 0, 5, 0xFFFFFF00)
    assert struct.unpack_from("<HHQQ", head, 31) == (1, 16, 0xFFFFFF00, 5)
    tail = Z.end_records(70000, 10, 20)
    assert struct.unpack_from("<I", tail)[0] == Z.END64 and len(tail) == 56 + 20 + 22


def test_blocks_join_into_one_stream(spark):
    parts = [b"abc" * 1000, b"", os.urandom(3000)]
    df = spark.createDataFrame([("a", 0, i, i == 2, p) for i, p in enumerate(parts)], "archive string, entry_index int, block int, is_last boolean, content binary")
    got = archives.deflate_blocks(df).orderBy("block").collect()
    assert zlib.decompress(b"".join(bytes(r.content) for r in got), -15) == b"".join(parts)


def test_stream_takes_each_archive_once(spark, tmp_path):
    inbox, seen = tmp_path / "in", []
    inbox.mkdir()
    (inbox / "a.zip").write_bytes(zips.archive([(b"a", b"1"), (b"b", b"22")]))
    (inbox / "b.zip").write_bytes(zips.overlap())
    for _ in range(2):
        intake.take_in(spark, str(inbox), str(tmp_path / "ck"), lambda df, _: seen.extend(df.collect()))
    assert sorted((os.path.basename(r.path), r.entries, r.error_code) for r in seen) == [("a.zip", 2, None), ("b.zip", None, "overlappingEntries")]


def test_names_in_cp932(spark, tmp_path):
    archives.register(spark)
    rows = [("a.zip", 0, "データ/日本語.txt", b"1"), ("a.zip", 1, "plain.txt", b"2")]
    archives.write_archives(items(spark, rows), str(tmp_path / "out"), name_encoding="cp932")
    entries = spark.read.format("zip_entries").load(str(tmp_path / "out"))
    got = listing.decoded_names(entries).orderBy("entry_index").collect()
    assert [(bytes(r.raw_name), r.flags, r.name) for r in got] == [(n.encode("cp932"), 0, n) for _, _, n, _ in rows]
    with pytest.raises(Exception, match="no CP932 form"):
        archives.write_archives(items(spark, [("b.zip", 0, "😀.txt", b"1")]), str(tmp_path / "none"), name_encoding="cp932")
    assert not (tmp_path / "none" / "b.zip").exists()
    with pytest.raises(ValueError, match="latin"):
        archives.compress(items(spark, rows), name_encoding="latin")


def block_items(spark, rows):
    df = spark.createDataFrame(rows, "archive string, entry_index int, block int, is_last boolean, name string, content binary")
    return df.withColumn("dos_time", F.lit(0x6F3C)).withColumn("dos_date", F.lit(0x5B01))


def test_blocks_become_entries(spark, tmp_path):
    archives.register(spark)
    parts = [b"abc" * 5000, b"", os.urandom(3000), b"abc" * 9]
    rows = [("a.zip", 1, i, i == 3, "big.bin", p) for i, p in enumerate(parts)] + [("a.zip", 0, 0, True, "small.txt", b"s" * 99), ("a.zip", 3, 0, True, "d/", b"")]
    rows += [("a.zip", 2, i, i == 1, "kept.JPG", p) for i, p in enumerate(parts[:2])]
    archives.write_blocks(block_items(spark, rows), str(tmp_path / "out"))
    with zipfile.ZipFile(tmp_path / "out" / "a.zip") as z:  # an independent reader
        assert z.testzip() is None and z.namelist() == ["small.txt", "big.bin", "kept.JPG", "d/"]
        assert z.read("big.bin") == b"".join(parts) and z.read("kept.JPG") == parts[0] and z.getinfo("kept.JPG").compress_type == 0
    assert os.listdir(tmp_path / "out") == ["a.zip"]
    for lost in (0, 1, 3):
        with pytest.raises(Exception, match="lacks block"):
            archives.write_blocks(block_items(spark, [r for i, r in enumerate(rows) if i != lost]), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []


def test_crc_of_joined_pieces():
    a, b = os.urandom(1000), os.urandom(777)
    assert Z.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert Z.crc_of_both(0, zlib.crc32(b), len(b)) == zlib.crc32(b) and Z.crc_of_both(zlib.crc32(a), 0, 0) == zlib.crc32(a)


def test_chunks_of_entries(spark, tmp_path):
    archives.register(spark)
    body = os.urandom(300) * 5000
    rows = [("a.zip", 0, "big.txt", body), ("a.zip", 1, "empty", b""), ("a.zip", 2, "dir/", b""), ("a.zip", 3, "exact", b"x" * 2 * 65536)]
    archives.write_archives(items(spark, rows), str(tmp_path / "out"))
    (tmp_path / "out" / "lie.zip").write_bytes(zips.size_lie())
    entries = spark.read.format("zip_entries").load(str(tmp_path / "out"))
    got = archives.read_chunks(entries, chunk_bytes=65536).orderBy("path", "entry_index", "chunk_index").collect()
    whole, lie = [r for r in got if r.path.endswith("a.zip")], [r for r in got if r.path.endswith("lie.zip")]
    assert max(len(r.content) for r in whole) == 65536
    for _, index, name, content in rows:
        own = [r for r in whole if r.entry_index == index]
        assert b"".join(bytes(r.content) for r in own) == content
        assert [r.chunk_index for r in own] == list(range(len(own))) and [r.is_last for r in own] == [False] * (len(own) - 1) + [True] * bool(own) and name
    assert (lie[-1].error_code, lie[-1].content, lie[-1].is_last) == ("sizeExceedsDeclared", None, True)
    assert {r.error_code for r in archives.read_chunks(entries.where("path like '%lie%'").limit(0)).collect()} == set()


def test_glob_opens_only_what_it_names(spark, tmp_path):
    archives.register(spark)
    (tmp_path / "bad.zip").write_bytes(b"not an archive")
    (tmp_path / "good.zip").write_bytes(zips.archive([(b"a", b"1")]))
    assert spark.read.format("zip_entries").option("pathGlobFilter", "g*.zip").load(str(tmp_path)).count() == 1


def test_one_archive_keeps_many_tasks_busy(spark, tmp_path):
    archives.register(spark)
    n = 3 * archives.RUN + 5
    rows = [("a.zip", i, f"{n - i}.txt", b"%d " % i * 9) for i in range(n)]
    archives.write_archives(items(spark, rows).repartition(3), str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == ["a.zip"]
    with zipfile.ZipFile(tmp_path / "out" / "a.zip") as z:  # an independent reader
        assert z.testzip() is None and z.namelist() == [r[2] for r in rows] and z.read("1.txt") == rows[-1][3]
    entries = spark.read.format("zip_entries").load(str(tmp_path / "out"))
    got = archives.read_contents(entries).select("entry_index", "content", F.spark_partition_id().alias("task")).collect()
    assert {r.entry_index: bytes(r.content) for r in got} == {r[1]: r[3] for r in rows} and len(got) == n
    assert len({r.task for r in got}) > 1
    with pytest.raises(Exception, match="twice"):  # in runs apart
        archives.write_archives(items(spark, [*rows, ("a.zip", n, "2.txt", b"")]), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []


def test_a_long_directory_is_not_held_as_rows(tmp_path):
    n = 40_000
    data, listed = io.BytesIO(), []
    for i in range(n):
        listed.append(zips.central(b"%06d.txt" % i, 0, 0, 0, data.tell()))
        data.write(zips.local(b"%06d.txt" % i, b""))
    directory_bytes = b"".join(listed)
    data.write(directory_bytes + zips.end(n, len(directory_bytes), data.tell()))
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    reader = archives._EntriesReader({"path": str(tmp_path / "a.zip")})
    (part,) = reader.partitions()
    tracemalloc.start()
    rows = sum(b.num_rows for b in reader.read(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and peak < 25_000_000  # 40,000 records as dictionaries take more than 40 MB


def test_a_long_directory_is_not_held_as_bytes(tmp_path):
    n = 40_000
    data, listed = io.BytesIO(), []
    for i in range(n):
        name = b"%06d" % i * (i % 300 + 20)  # records lie across the blocks that are read
        listed.append(zips.central(name, 0, 0, 0, data.tell()))
        data.write(zips.local(name, b""))
    directory_bytes = b"".join(listed)
    data.write(directory_bytes + zips.end(n, len(directory_bytes), data.tell()))
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    reader = archives._EntriesReader({"path": str(tmp_path / "a.zip")})
    (part,) = reader.partitions()
    tracemalloc.start()
    indices = [i for b in reader.read(part) for i in b.column("entry_index").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert indices == list(range(n)) and len(directory_bytes) > 40_000_000 and peak < 30_000_000
    names = [name for b in reader.read(part) for name in b.column("raw_name").to_pylist()]
    assert names == [i.filename.encode() for i in zipfile.ZipFile(tmp_path / "a.zip").infolist()]  # an independent reader


def test_directories_out_of_order():
    bodies = [zips.local(b"%d" % i, b"body") for i in range(3)]
    places = [sum(map(len, bodies[:i])) for i in range(3)]

    def made(offsets):
        listed = b"".join(zips.central(b"%d" % i, 4, 4, zlib.crc32(b"body"), offsets[i]) for i in (2, 0, 1))
        return b"".join(bodies) + listed + zips.end(3, len(listed), len(b"".join(bodies)))

    assert [e["raw_name"] for e in directory(made(places))] == [b"2", b"0", b"1"]
    for offsets, code in (([0, 0, places[2]], "overlappingEntries"), ([places[1], 1, places[2]], "overlappingEntries"), ([0, 1 << 20, 0], "corrupt")):
        with pytest.raises(Z.ZipError) as e:
            directory(made(offsets))
        assert e.value.code == code
