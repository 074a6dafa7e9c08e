"""Archives as DataFrames: entries scan, payload reader, archive sink.

Files are opened through pyarrow's file systems, so a path can be local or any
store that pyarrow knows, and only the bytes asked for are read.
"""

from __future__ import annotations

import os
import pickle
import shutil
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row

from coffer.sources import ciphers
from coffer.sources import zipfile_format as Z

ENTRIES = (
    "path string, entry_index int, raw_name binary, flags int, method_raw int, dos_time int, dos_date int, crc32 bigint, compressed_size decimal(20,0), "
    "uncompressed_size decimal(20,0), local_header_offset decimal(20,0), external_attributes bigint, version_made_by int, "
    "encryption struct<kind:string,strength_bits:int,vendor_version:int,actual_method:int>, error_code string"
)
CONTENTS = "path string, entry_index int, content binary, status string, error_code string, actual_size bigint, actual_crc bigint"


def _open(path: str):
    from pyarrow import fs

    system, inner = (fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path))
    file = system.open_input_file(inner)
    return file, file.size()


def _files(path: str, glob: str = "*") -> list[str]:
    from fnmatch import fnmatchcase

    from pyarrow import fs

    system, inner = (fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path))
    if system.get_file_info(inner).type == fs.FileType.Directory:
        found = [i.path for i in system.get_file_info(fs.FileSelector(inner, recursive=True)) if i.is_file and i.path.lower().endswith(".zip") and fnmatchcase(i.base_name, glob)]
        return sorted(path[: len(path) - len(inner)] + p for p in found)
    return [path]


@dataclass
class _Archive(InputPartition):
    path: str


#: Directory records in one Arrow batch, and payload bytes after which a batch of contents is handed on.
BATCH, HELD = 8192, 4 << 20


def _entry_batch(path: str, found: list[dict], error_code: str | None = None) -> pa.RecordBatch:
    """Rows of the entries schema; sizes are unsigned 64-bit numbers and become decimals."""
    kinds = pa.struct([("kind", pa.string()), ("strength_bits", pa.int32()), ("vendor_version", pa.int32()), ("actual_method", pa.int32())])
    small = ["entry_index", "flags", "method_raw", "dos_time", "dos_date", "version_made_by"]
    columns = {k: pa.array([e[k] for e in found], pa.int32()) for k in small} | {k: pa.array([e[k] for e in found], pa.int64()) for k in ("crc32", "external_attributes")}
    columns |= {k: pa.array([e[k] for e in found], pa.uint64()).cast(pa.decimal128(20, 0)) for k in ("compressed_size", "uncompressed_size", "local_header_offset")}
    columns |= {"path": pa.array([path] * len(found)), "raw_name": pa.array([e["raw_name"] for e in found], pa.binary())}
    columns |= {"encryption": pa.array([e["encryption"] for e in found], kinds), "error_code": pa.array([error_code] * len(found), pa.string())}
    names = [field.split(" ")[0] for field in ENTRIES.replace("(20,0)", "").split(", ")]
    return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


_REFUSED = dict.fromkeys(("entry_index", "flags", "method_raw", "dos_time", "dos_date", "version_made_by", "crc32", "external_attributes", "compressed_size", "uncompressed_size", "local_header_offset", "raw_name", "encryption"))


class _EntriesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.permissive = options["path"], options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.glob = options.get("pathGlobFilter", "*")

    def partitions(self) -> list[InputPartition]:
        return [_Archive(p) for p in _files(self.path, self.glob)]

    def read(self, part: _Archive) -> Iterator[pa.RecordBatch]:
        file, length = _open(part.path)
        with file:
            try:
                place = Z.checked_directory(file, length)
            except Z.ZipError as e:
                if not self.permissive:
                    raise
                yield _entry_batch(part.path, [_REFUSED], e.code)
                return
            records = Z.records(file, *place)
            while (batch := _entry_batch(part.path, list(islice(records, BATCH)))).num_rows:
                yield batch


class ZipEntries(DataSource):
    """``spark.read.format("zip_entries").load(path)``: one row for each directory record, one task for each archive.

    ``path`` is an archive or a folder of them, of which ``pathGlobFilter``
    chooses by file name without opening the others. With ``mode`` PERMISSIVE a
    refused archive gives one row with its error_code and no entries.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _EntriesReader(self.options)


#: Neighbouring entries of an archive that go to a task together, to be written or read in order.
RUN = 1024


def _dealt(rows: DataFrame, archive: str, *order: str) -> DataFrame:
    """Rows spread over ``spark.sql.shuffle.partitions`` tasks by runs of entries, so that no archive is left to one task."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, archive, F.floor(F.col("entry_index") / RUN)).sortWithinPartitions(archive, "entry_index", *order)


#: Columns of the entries that reading takes.
_TO_READ = ["path", "entry_index", "raw_name", "flags", "method_raw", "dos_time", "crc32", "compressed_size", "uncompressed_size", "local_header_offset", "encryption", "error_code"]


def _to_read(entries: DataFrame) -> DataFrame:
    return _dealt(entries.select(*[c for c in _TO_READ if c in entries.columns]), "path")


def entry_pieces(file, e: dict, password: str | None) -> Iterator[bytes]:
    """The content of one entry in bounded pieces; a ZipError as soon as it shows, size and CRC after the last piece."""
    kind, method = e["encryption"]["kind"], e["method_raw"]
    actual = e["encryption"]["actual_method"] if kind == "aes" else method
    if actual not in (0, 8):
        raise Z.ZipError("unsupportedMethod", str(actual))
    at, left = Z.data_offset(file, int(e["local_header_offset"])), int(e["compressed_size"])
    if kind != "none" and password is None:
        raise Z.ZipError("passwordRequired")

    def chunks(at: int, left: int) -> Iterator[bytes]:
        while left:
            n = min(left, Z.CHUNK)
            yield Z.read_at(file, at, n)
            at, left = at + n, left - n

    if kind == "zipCrypto":
        body = ciphers.zipcrypto_opened(chunks, at, left, password, e["dos_time"] >> 8 if e["flags"] & 8 else e["crc32"] >> 24)
    elif kind == "aes":
        body = ciphers.aes_opened(chunks, at, left, password, e["encryption"]["strength_bits"] // 8)
    else:
        body = chunks(at, left)
    size, crc = 0, 0
    for piece in Z.inflate_bounded(body, actual, int(e["uncompressed_size"])):
        size, crc = size + len(piece), zlib.crc32(piece, crc)
        yield piece
    for _ in body:  # the authentication code stands at the end
        pass
    if size != e["uncompressed_size"]:
        raise Z.ZipError("corrupt", "size mismatch")
    if not (kind == "aes" and e["encryption"]["vendor_version"] >= 2) and crc != e["crc32"]:
        raise Z.ZipError("crcMismatch")


def entry_content(file, e: dict, password: str | None) -> tuple[bytes, int]:
    """(content, crc) of one entry, or a ZipError."""
    content = b"".join(entry_pieces(file, e, password))
    return content, zlib.crc32(content)


def read_contents(entries: DataFrame, password: str | None = None, max_bytes: int = 1 << 30) -> DataFrame:
    """Payloads of the given entries; filter entries first, only theirs are read.

    Each row tells its own outcome: status ok, directory, or error with the
    code. Entries that declare more than ``max_bytes`` are not read into a row;
    :func:`read_chunks` reads entries of any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("entry_index", pa.int32()), ("content", pa.binary()), ("status", pa.string()), ("error_code", pa.string()), ("actual_size", pa.int64()), ("actual_crc", pa.int64())])

        def rows_batch(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        opened, made, held = (None, None), [], 0
        for batch in batches:
            for e in batch.to_pylist():
                row = [e["path"], e["entry_index"], None, "error", None, None, None]
                if e["raw_name"] is None or e["raw_name"].endswith(b"/"):
                    row[3] = "error" if e["raw_name"] is None else "directory"
                    row[4] = e.get("error_code")
                elif e["uncompressed_size"] > max_bytes:
                    row[4] = "tooLarge"
                else:
                    try:
                        if opened[0] != e["path"]:
                            if opened[1] is not None:
                                opened[1].close()
                            opened = e["path"], _open(e["path"])[0]
                        content, crc = entry_content(opened[1], e, password)
                        row[2:] = content, "ok", None, len(content), crc
                    except Z.ZipError as error:
                        row[4] = error.code
                made.append(row)
                held += row[5] or 0
                # payloads can be large, rows are many
                if held >= HELD or len(made) == RUN:
                    yield rows_batch(made)
                    made, held = [], 0
        if made:
            yield rows_batch(made)

    return _to_read(entries).mapInArrow(run, CONTENTS)


CHUNKS = "path string, entry_index int, chunk_index long, content binary, is_last boolean, error_code string"


def read_chunks(entries: DataFrame, password: str | None = None, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Payloads of the given files of any size, as rows of at most ``chunk_bytes`` numbered from 0.

    An entry is whole if its row with ``is_last`` has no error_code; size, CRC
    and authentication code are checked by then. A failed entry ends with a
    row that has the code and no content, and what came before is void.
    Folders give no row, refused archives one. An empty file has one empty chunk.
    """
    schema = pa.schema([("path", pa.string()), ("entry_index", pa.int32()), ("chunk_index", pa.int64()), ("content", pa.binary()), ("is_last", pa.bool_()), ("error_code", pa.string())])

    def chunks(file, e: dict) -> Iterator[bytes]:
        held, size = [], 0
        for piece in entry_pieces(file, e, password):
            while size + len(piece) > chunk_bytes:
                cut = chunk_bytes - size
                yield b"".join([*held, piece[:cut]])
                held, size, piece = [], 0, piece[cut:]
            held.append(piece)
            size += len(piece)
        yield b"".join(held)

    def rows(e: dict, opened: dict) -> Iterator[tuple]:
        held, n = None, 0
        try:
            if e["raw_name"] is None:
                raise Z.ZipError(e.get("error_code") or "corrupt")
            if e["path"] not in opened:
                for file in opened.values():
                    file.close()
                opened.clear()
                opened[e["path"]] = _open(e["path"])[0]
            for chunk in chunks(opened[e["path"]], e):
                if held is not None:
                    yield n, held, False, None
                    n += 1
                held = chunk
            yield n, held, True, None
        except Z.ZipError as error:
            yield n, None, True, error.code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            for e in batch.to_pylist():
                if e["raw_name"] is None or not e["raw_name"].endswith(b"/"):
                    for row in rows(e, opened):
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (e["path"], e["entry_index"], *row), strict=True))], schema)

    return _to_read(entries).mapInArrow(run, CHUNKS)


@dataclass
class _Written(WriterCommitMessage):
    parts: list[tuple[str, str]]


class _Assembly:
    """One archive on its way to a part file; an entry is one row, or several blocks in order."""

    def __init__(self, place: str, password: str | None):
        self.file, self.password = open(place, "xb"), password
        self.central, self.offset, self.names, self.started = [], 0, set(), None

    def take(self, r: Row) -> None:
        if self.started is None and r.block == 0 and r.is_last:
            self._whole(r)
        else:
            self._block(r)

    def _name(self, r: Row) -> bytes:
        raw = bytes(r.raw_name)
        if len(raw) > 65535 or raw in self.names:
            raise ValueError(f"name too long or twice in {r.archive}: {raw[:80]!r}")
        self.names.add(raw)
        return raw

    def _list(self, *values) -> None:
        self.central.append(Z.central_record(*values))

    def _whole(self, r: Row) -> None:
        raw, payload, method, flags, extra, crc = self._name(r), bytes(r.payload), r.method, r.flags, b"", r.crc32
        if self.password is not None and not raw.endswith(b"/"):
            payload, extra = ciphers.aes_sealed(payload, self.password, method)
            method, flags, crc = 99, flags | 1, 0
        header = Z.local_header(raw, flags, method, r.dos_time, r.dos_date, crc, len(payload), r.size, extra)
        self.file.write(header)
        self.file.write(payload)
        self._list(raw, flags, method, r.dos_time, r.dos_date, crc, len(payload), r.size, self.offset, raw.endswith(b"/"), extra)
        self.offset += len(header) + len(payload)

    def _block(self, r: Row) -> None:
        if self.started is None:
            if self.password is not None:
                raise ValueError("entries in blocks cannot be encrypted")
            raw = self._name(r)
            # sizes and CRC are known after the last block, when the header is written over
            header = Z.local_header(raw, r.flags, r.method, r.dos_time, r.dos_date, 0, 0, 0, wide=True)
            self.file.write(header)
            self.started = {"entry": r.entry_index, "raw": raw, "next": 0, "crc": 0, "packed": 0, "full": 0, "header": len(header)}
        on = self.started
        if (r.entry_index, r.block) != (on["entry"], on["next"]):
            raise ValueError(f"{r.archive}: entry {on['entry']} lacks block {on['next']}")
        self.file.write(r.payload)
        on.update(next=r.block + 1, crc=Z.crc_of_both(on["crc"], r.crc32, r.size), packed=on["packed"] + len(r.payload), full=on["full"] + r.size)
        if r.is_last:
            values = on["raw"], r.flags, r.method, r.dos_time, r.dos_date, on["crc"], on["packed"], on["full"]
            self.file.seek(self.offset)
            self.file.write(Z.local_header(*values, wide=True))
            self.file.seek(0, os.SEEK_END)
            self._list(*values, self.offset, False)
            self.offset, self.started = self.offset + on["header"] + on["packed"], None

    def _whole_so_far(self) -> None:
        if self.started is not None:
            raise ValueError(f"entry {self.started['entry']} lacks block {self.started['next']}")

    def close(self) -> None:
        self._whole_so_far()
        directory = b"".join(self.central)
        self.file.write(directory + Z.end_records(len(self.central), len(directory), self.offset))
        self.file.close()


class _Segment(_Assembly):
    """A run of an archive's entries; what its directory needs to know goes to a file beside, with offsets from the segment's start."""

    def __init__(self, archive: str, run: int, place: str, password: str | None):
        super().__init__(place, password)
        self.archive, self.run, self.place = archive, run, place

    def _list(self, *values) -> None:
        self.central.append(values)

    def close(self) -> tuple:
        self._whole_so_far()
        self.file.close()
        with open(f"{self.place}.dir", "xb") as f:
            pickle.dump(self.central, f)
        return self.archive, self.run, self.place


class _ZipWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.password, self.job = options.get("password"), uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> _Written:
        """Archives of this partition, each to a name of its own attempt; rows come sorted by archive, entry and block."""
        os.makedirs(self.folder, exist_ok=True)
        parts, current, made = [], None, None
        try:
            for r in rows:
                if r.archive != current:
                    if made:
                        made.close()
                    current = r.archive
                    parts.append((f"{self.folder}/.{self.job}.{uuid.uuid4().hex}.part", f"{self.folder}/{current}"))
                    made = _Assembly(parts[-1][0], self.password)
                made.take(r)
            if made:
                made.close()
        except BaseException:
            for part, _ in parts:
                if os.path.exists(part):
                    os.unlink(part)
            raise
        return _Written(parts)

    def _sweep(self) -> None:
        """Remove the job's parts that are left, those of killed attempts among them."""
        for name in os.listdir(self.folder) if os.path.isdir(self.folder) else ():
            if name.startswith(f".{self.job}."):
                os.unlink(f"{self.folder}/{name}")

    def commit(self, messages: list[_Written]) -> None:
        done = []
        for part, target in sorted(p for m in messages if m for p in m.parts):
            if self.overwrite:
                os.replace(part, target)
            else:
                try:
                    os.link(part, target)  # fails if the archive exists
                except FileExistsError:
                    for made in done:
                        os.unlink(made)
                    self._sweep()
                    raise
                os.unlink(part)
            done.append(target)
        self._sweep()

    def abort(self, messages: list[_Written]) -> None:
        self._sweep()


class ZipArchives(DataSource):
    """``df.write.format("zip")``: one archive file for each value of ``archive``, in the folder ``path``."""

    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return PACKED

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ZipWriter(self.options, overwrite)


PACKED = "archive string, entry_index long, block long, is_last boolean, raw_name binary, flags int, method int, dos_time int, dos_date int, crc32 long, size long, payload binary"
HEAD, WORTHWHILE = 256 << 10, 0.97


def _packed_rows(items: DataFrame, clean: bool, name_encoding: str, block: Column, is_last: Column, stored: Column) -> DataFrame:
    """Rows of the sink before compression: encoded names and flags, method by extension, CRC and size of the content."""
    from coffer.functions import names as N

    if name_encoding not in ("utf8", "cp932"):
        raise ValueError(f"name_encoding {name_encoding!r}")
    rows = items.where(~N.is_junk(F.col("name"))) if clean else items
    if name_encoding == "utf8":
        name = N.nfc(F.col("name"))
        raw, flags = name.cast("binary"), F.when(N.needs_utf8_flag(name), 2048).otherwise(0)
    else:
        code = N.cp932_encode(F.col("name"))
        raw, flags = F.when(code.isNotNull(), code).otherwise(F.raise_error(F.concat(F.lit("no CP932 form of name: "), "name"))), F.lit(0)
    kept = N.stored_by_extension(F.col("name")) | F.col("name").endswith("/") | stored
    return rows.select(
        "archive", F.col("entry_index").cast("long").alias("entry_index"), block.cast("long").alias("block"), is_last.alias("is_last"), raw.alias("raw_name"), flags.alias("flags"),
        F.when(kept, 0).otherwise(8).alias("method"), F.col("dos_time").cast("int").alias("dos_time"), F.col("dos_date").cast("int").alias("dos_date"),
        F.crc32("content").alias("crc32"), F.octet_length("content").cast("long").alias("size"), F.col("content").cast("binary").alias("payload"),
    )


def _replaced(batch: pa.RecordBatch, methods: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"method": pa.array(methods, pa.int32()), "payload": pa.array(payloads, pa.binary())}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _each_batch(rows: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    return rows.mapInArrow(lambda batches: map(change, batches), PACKED)


def _whole_rows(items: DataFrame, clean: bool, name_encoding: str) -> DataFrame:
    return _packed_rows(items, clean, name_encoding, F.lit(0), F.lit(True), F.lit(False))


def _block_rows(blocks: DataFrame, clean: bool, name_encoding: str) -> DataFrame:
    stored = F.col("stored") if "stored" in blocks.columns else F.lit(False)
    return _packed_rows(blocks, clean, name_encoding, F.col("block"), F.col("is_last"), stored)


def _deflated(batch: pa.RecordBatch) -> pa.RecordBatch:
    methods, payloads = batch.column("method").to_pylist(), batch.column("payload").to_pylist()
    for i, (method, body) in enumerate(zip(methods, payloads, strict=True)):
        if method == 8 and not worthwhile(body):
            methods[i] = 0
        elif method == 8:
            engine = zlib.compressobj(6, zlib.DEFLATED, -15)
            payloads[i] = engine.compress(body) + engine.flush()
    return _replaced(batch, methods, payloads)


def _deflated_blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
    methods, payloads, last = (batch.column(k).to_pylist() for k in ("method", "payload", "is_last"))
    return _replaced(batch, methods, [deflated_block(p, end) if m == 8 else p for m, p, end in zip(methods, payloads, last, strict=True)])


def compress(items: DataFrame, clean: bool = True, name_encoding: str = "utf8") -> DataFrame:
    """Packed rows of (archive, entry_index, name, content, dos_time, dos_date): method by extension and probe, raw deflate, CRC.

    A file is stored if it is empty, if its extension says it is compressed, or
    if its first 256 KiB do not deflate below 0.97 of their size. Names are NFC,
    in UTF-8 with its flag where they need it, or in CP932 without a flag,
    where a name that CP932 cannot express is an error.
    """

    return _each_batch(_whole_rows(items, clean, name_encoding), _deflated)


def compress_blocks(blocks: DataFrame, clean: bool = True, name_encoding: str = "utf8") -> DataFrame:
    """Packed rows of files cut into blocks: (archive, entry_index, block, is_last, name, content, dos_time, dos_date).

    Blocks are numbered from 0; each is deflated by itself and they join into one stream. A column ``stored`` marks files that
    are not worth deflating; extensions tell others. Without it no block is probed, as all blocks of a file
    must agree.
    """
    return _each_batch(_block_rows(blocks, clean, name_encoding), _deflated_blocks)


def deflated_block(body: bytes, last: bool) -> bytes:
    """A part of a deflate stream that ends at a byte, or ends the stream."""
    engine = zlib.compressobj(6, zlib.DEFLATED, -15)
    return engine.compress(body) + engine.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH)


def worthwhile(content: bytes) -> bool:
    """Whether deflating pays, judged by the first 256 KiB."""
    if not content:
        return False
    head = content[:HEAD]
    engine = zlib.compressobj(6, zlib.DEFLATED, -15)
    return len(engine.compress(head)) + len(engine.flush(zlib.Z_SYNC_FLUSH)) < WORTHWHILE * len(head)


SEGMENTS = "archive string, run long, place string"
#: Rows that are deflated and sealed at a time.
ROWS = 128


def _segments(packed: DataFrame, deflate: Callable[[pa.RecordBatch], pa.RecordBatch], stem: str, password: str | None) -> DataFrame:
    """Deflate, seal and write all rows, each run of an archive's entries to a file of its own attempt; one row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("run", pa.int64()), ("place", pa.string())])
        made = None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, made.close(), strict=True))], schema)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for values in deflate(batch.slice(at, ROWS)).to_pylist():
                    r = SimpleNamespace(**values)
                    if made is None or (made.archive, made.run) != (r.archive, r.entry_index // RUN):
                        if made is not None:
                            yield closed()
                        made = _Segment(r.archive, r.entry_index // RUN, f"{stem}.{uuid.uuid4().hex}.segment", password)
                    made.take(r)
        if made is not None:
            yield closed()

    return _dealt(packed, "archive", "block").mapInArrow(run, SEGMENTS)


def _names_differ(spark: SparkSession, found: list[Row]) -> None:
    """Refuse names that stand twice in an archive."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open(f"{place}.dir", "rb") as f:
                    listed = [values[0] for values in pickle.load(f)]
                yield pa.RecordBatch.from_arrays([pa.array([archive] * len(listed), pa.string()), pa.array(listed, pa.binary())], names=["archive", "raw_name"])

    places = spark.createDataFrame([(r.archive, r.place) for r in found], "archive string, place string")
    twice = places.mapInArrow(names, "archive string, raw_name binary").groupBy("archive", "raw_name").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"name twice in {twice[0].archive}: {bytes(twice[0].raw_name)[:80]!r}")


def _join_segments(spark: SparkSession, found: list[Row], stem: str) -> list[tuple[str, str]]:
    """Join the segments of each archive, in order, and add its directory; (archive, part file)."""

    def joined(places: list[str]) -> str:
        part, starts, count, size = f"{stem}.{uuid.uuid4().hex}.part", [], 0, 0
        with open(part, "xb") as out:
            for place in places:
                starts.append(out.tell())
                with open(place, "rb") as f:
                    shutil.copyfileobj(f, out, 8 << 20)
            end = out.tell()
            for place, start in zip(places, starts, strict=True):
                with open(f"{place}.dir", "rb") as f:
                    for values in pickle.load(f):
                        record = Z.central_record(*values[:8], start + values[8], *values[9:])
                        out.write(record)
                        count, size = count + 1, size + len(record)
            out.write(Z.end_records(count, size, end))
        return part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([archive], pa.string()), pa.array([joined(places)], pa.string())], names=["archive", "part"])

    by: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r.archive, r.run)):
        by.setdefault(r.archive, []).append(r.place)
    rows = spark.createDataFrame(list(by.items()), "archive string, places array<string>").repartition(len(by), "archive")
    return [(r.archive, r.part) for r in rows.mapInArrow(run, "archive string, part string").collect()]


def _assembled(packed: DataFrame, deflate: Callable[[pa.RecordBatch], pa.RecordBatch], folder: str, password: str | None, overwrite: bool) -> None:
    spark, writer = packed.sparkSession, _ZipWriter({"path": folder}, overwrite)
    os.makedirs(folder, exist_ok=True)
    stem = f"{folder}/.{writer.job}"
    try:
        found = _segments(packed, deflate, stem, password).collect()
        parts = []
        if found:
            _names_differ(spark, found)
            parts = [(part, f"{folder}/{archive}") for archive, part in _join_segments(spark, found, stem)]
        writer.commit([_Written(parts)])
    except BaseException:
        writer.abort([])
        raise


def write_archives(items: DataFrame, folder: str, password: str | None = None, overwrite: bool = False, clean: bool = True, name_encoding: str = "utf8") -> None:
    """Write one archive for each ``archive``; runs of entries are compressed, sealed and written by all tasks, then joined in order."""
    _assembled(_whole_rows(items, clean, name_encoding), _deflated, folder, password, overwrite)


def write_blocks(blocks: DataFrame, folder: str, overwrite: bool = False, clean: bool = True, name_encoding: str = "utf8") -> None:
    """Like :func:`write_archives` for files in blocks, so that no task holds a whole file; a missing block is an error."""
    _assembled(_block_rows(blocks, clean, name_encoding), _deflated_blocks, folder, None, overwrite)


def deflate_blocks(blocks: DataFrame) -> DataFrame:
    """(archive, entry_index, block, is_last, content) to deflated blocks that join into one stream by block number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [deflated_block(body, last) for body, last in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], names=batch.schema.names)

    rows = blocks.select("archive", F.col("entry_index").cast("long").alias("entry_index"), F.col("block").cast("long").alias("block"), "is_last", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(run, "archive string, entry_index long, block long, is_last boolean, content binary")


def register(spark: SparkSession) -> None:
    """Make the formats ``zip_entries`` and ``zip`` known to a session."""
    spark.dataSource.register(ZipEntries)
    spark.dataSource.register(ZipArchives)
