"""The ZIP container: directory parsing and record building, from the published format note.

Small helpers that run inside Spark tasks on one archive at a time; every length
is checked before use, so hostile archives give an error code, not a crash.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np

LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
MAX_DIRECTORY = 256 << 20
CHUNK = 256 << 10
#: Bytes of a directory that are read at a time, and of its longest record.
BLOCK, LONGEST = 1 << 20, 46 + 3 * 65535
#: Salt bytes of each AES strength are half the key; the strength byte counts 64-bit steps from 128.
AES_KEY_BYTES = {1: 16, 2: 24, 3: 32}


class ZipError(Exception):
    """``code`` is one of notAZipFile, corrupt, overlappingEntries, unsupportedMethod, passwordRequired, wrongPassword,
    authenticationFailed, sizeExceedsDeclared, crcMismatch."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}")
        self.code, self.detail = code, detail


def _take(data: bytes, form: str, at: int) -> tuple:
    if at < 0 or at + struct.calcsize(form) > len(data):
        raise ZipError("corrupt", "record ends early")
    return struct.unpack_from(form, data, at)


def read_at(file: BinaryIO, at: int, count: int) -> bytes:
    file.seek(at)
    got = file.read(count)
    if len(got) != count:
        raise ZipError("corrupt", "file ends early")
    return bytes(got)


def _directory_place(file: BinaryIO, length: int) -> tuple[int, int, int]:
    """(entries, bytes, offset) of the central directory."""
    if length < 22:
        raise ZipError("notAZipFile", "too short")
    tail_at = max(0, length - 22 - 65535)
    tail = read_at(file, tail_at, length - tail_at)
    at = tail.rfind(struct.pack("<I", END), 0, len(tail) - 18)
    if at < 0:
        raise ZipError("notAZipFile", "no end record")
    count, size, offset = _take(tail, "<HII", at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (size, offset):
        place = tail_at + at - 20
        if place < 0:
            raise ZipError("corrupt", "no room for a 64-bit locator")
        signature, _, where = struct.unpack("<IIQ", read_at(file, place, 16))
        if signature != LOCATOR64 or where > length - 56:
            raise ZipError("corrupt", "64-bit locator")
        record = read_at(file, where, 56)
        if _take(record, "<I", 0)[0] != END64:
            raise ZipError("corrupt", "64-bit end record")
        count, size, offset = _take(record, "<QQQ", 32)
    if size > MAX_DIRECTORY or size > length or offset > length - size:
        raise ZipError("corrupt", "directory lies outside the file")
    return count, size, offset


def _extras(extra: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if at + 4 + size > len(extra):
            return  # a malformed tail is ignored
        yield kind, extra[at + 4 : at + 4 + size]
        at += 4 + size


def records(file: BinaryIO, count: int, size: int, offset: int) -> Iterator[dict]:
    """The central records of a directory in order, as dictionaries of the entries schema without ``path``; a block of bytes is held at a time."""
    data, at, left = b"", 0, size
    for index in range(count):
        if left and len(data) - at < LONGEST:
            block = read_at(file, offset + size - left, min(left, BLOCK))
            data, at, left = data[at:] + block, 0, left - len(block)
        if _take(data, "<I", at)[0] != CENTRAL:
            raise ZipError("corrupt", f"directory record {index}")
        made, _, flags, method, time, date, crc, packed, full, n_name, n_extra, n_comment, _, _, attributes, local = _take(data, "<HHHHHHIIIHHHHHII", at + 4)
        end = at + 46 + n_name + n_extra + n_comment
        if end > len(data):
            raise ZipError("corrupt", f"directory record {index}")
        name, extra = data[at + 46 : at + 46 + n_name], data[at + 46 + n_name : at + 46 + n_name + n_extra]
        aes = None
        for kind, body in _extras(extra):
            if kind == 1:
                # fields are there only for values that are at their limit, in this order
                place, values = 0, [full, packed, local]
                for i, value in enumerate(values):
                    if value == 0xFFFFFFFF:
                        values[i] = _take(body, "<Q", place)[0]
                        place += 8
                full, packed, local = values
            elif kind == 0x9901 and len(body) >= 7:
                aes = struct.unpack_from("<H2sBH", body)
        encryption = {"kind": "none", "strength_bits": None, "vendor_version": None, "actual_method": None}
        if flags & 1 and method == 99:
            if aes is None or aes[2] not in AES_KEY_BYTES:
                raise ZipError("corrupt", "AES record")
            encryption = {"kind": "aes", "strength_bits": 8 * AES_KEY_BYTES[aes[2]], "vendor_version": aes[0], "actual_method": aes[3]}
        elif flags & 1:
            encryption["kind"] = "zipCrypto"
        yield {
            "entry_index": index, "raw_name": name, "flags": flags, "method_raw": method, "dos_time": time, "dos_date": date, "crc32": crc, "compressed_size": packed,
            "uncompressed_size": full, "local_header_offset": local, "external_attributes": attributes, "version_made_by": made, "encryption": encryption,
        }
        at = end


def checked_directory(file: BinaryIO, length: int) -> tuple[int, int, int]:
    """What :func:`records` takes, once all records are found to be sound; none of them is kept."""
    place = _directory_place(file, length)
    if not _in_order(records(file, *place), length):
        check_ranges(records(file, *place), length)
    return place


def read_directory(file: BinaryIO, length: int) -> list[dict]:
    """All central records in order, as dictionaries of the entries schema without ``path``."""
    return list(records(file, *checked_directory(file, length)))


def _ranges(entries: Iterable[dict], length: int) -> Iterator[tuple[int, int]]:
    """The bytes of each file, at least; an error if they lie outside the archive."""
    for e in entries:
        if not e["raw_name"].endswith(b"/"):
            end = e["local_header_offset"] + 30 + len(e["raw_name"]) + e["compressed_size"]
            if end > length:
                raise ZipError("corrupt", "entry lies outside the file")
            yield e["local_header_offset"], end


def _in_order(entries: Iterable[dict], length: int) -> bool:
    """Whether each file begins after the one before, as most archives are written; nothing is kept to tell."""
    before, ordered = 0, True
    for begin, end in _ranges(entries, length):
        ordered, before = ordered and begin >= before, end
    return ordered


def check_ranges(entries: Iterable[dict], length: int) -> None:
    """Refuses archives whose files lie outside the file or share bytes, in any order."""
    begins, ends = array("Q"), array("Q")
    for begin, end in _ranges(entries, length):
        begins.append(begin)
        ends.append(end)
    first = np.frombuffer(begins, np.uint64) if begins else np.zeros(0, np.uint64)
    last = np.frombuffer(ends, np.uint64) if ends else np.zeros(0, np.uint64)
    order = np.lexsort((last, first))
    if (first[order][1:] < last[order][:-1]).any():
        raise ZipError("overlappingEntries")


def data_offset(file: BinaryIO, local_header_offset: int) -> int:
    """Where the payload starts, by the lengths in the local header."""
    header = read_at(file, local_header_offset, 30)
    if _take(header, "<I", 0)[0] != LOCAL:
        raise ZipError("corrupt", "local header")
    n_name, n_extra = _take(header, "<HH", 26)
    return local_header_offset + 30 + n_name + n_extra


def inflate_bounded(chunks: Iterator[bytes], method: int, declared: int) -> Iterator[bytes]:
    """Decoded chunks; stops with an error at the first byte beyond ``declared``."""
    made = 0

    def bounded(piece: bytes) -> bytes:
        nonlocal made
        made += len(piece)
        if made > declared:
            raise ZipError("sizeExceedsDeclared")
        return piece

    if method == 0:
        for chunk in chunks:
            yield bounded(chunk)
        return
    engine = zlib.decompressobj(-15)
    try:
        for chunk in chunks:
            while chunk:
                piece = engine.decompress(chunk, min(CHUNK, declared - made + 1))
                chunk = engine.unconsumed_tail
                if piece:
                    yield bounded(piece)
                elif not chunk or engine.eof:
                    break
        piece = engine.flush()
        if piece:
            yield bounded(piece)
    except zlib.error as e:
        raise ZipError("corrupt", str(e)) from None
    if not engine.eof:
        raise ZipError("corrupt", "deflate stream ends early")


_POLYNOMIAL = 0xEDB88320


def _product(a: int, b: int) -> int:
    """Product of two polynomials modulo that of the CRC; the highest bit is the constant term."""
    out = 0
    for shift in range(31, -1, -1):
        if a >> shift & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def crc_of_both(first: int, second: int, size: int) -> int:
    """CRC-32 of two joined pieces from theirs, the second of ``size`` bytes: the first times x**(8 * size), plus the second."""
    power, square, left = 1 << 31, 1 << 30, 8 * size
    while left:
        if left & 1:
            power = _product(power, square)
        square, left = _product(square, square), left >> 1
    return _product(first, power) ^ second


def local_header(name: bytes, flags: int, method: int, time: int, date: int, crc: int, packed: int, full: int, extra: bytes = b"", wide: bool = False) -> bytes:
    """A local header; sizes from 0xFFFFFF00, or all if ``wide``, go to a 64-bit extra field."""
    if wide or max(packed, full) >= 0xFFFFFF00:
        extra = struct.pack("<HHQQ", 1, 16, full, packed) + extra
        packed = full = 0xFFFFFFFF
    return struct.pack("<IHHHHHIIIHH", LOCAL, 45 if full == 0xFFFFFFFF else 20, flags, method, time, date, crc, packed, full, len(name), len(extra)) + name + extra


def central_record(name: bytes, flags: int, method: int, time: int, date: int, crc: int, packed: int, full: int, offset: int, directory: bool, extra: bytes = b"") -> bytes:
    """A directory record made by Unix 2.0: folders 040755, files 100644."""
    wide = []
    if full >= 0xFFFFFF00 or packed >= 0xFFFFFF00:
        wide += [full, packed]
        full = packed = 0xFFFFFFFF
    if offset >= 0xFFFFFFFF:
        wide.append(offset)
        offset = 0xFFFFFFFF
    if wide:
        extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) + extra
    attributes = (0o040755 << 16 | 0x10) if directory else (0o100644 << 16 | 0x20)
    return struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 3 << 8 | 20, 45 if wide else 20, flags, method, time, date, crc, packed, full, len(name), len(extra), 0, 0, 0, attributes, offset) + name + extra


def end_records(count: int, size: int, offset: int) -> bytes:
    """The end of an archive, with 64-bit records where a value is at its limit."""
    out = b""
    if count >= 0xFFFF or size >= 0xFFFFFFFF or offset >= 0xFFFFFFFF:
        out = struct.pack("<IQHHIIQQQQ", END64, 44, 3 << 8 | 45, 45, 0, 0, count, count, size, offset)
        out += struct.pack("<IIQI", LOCATOR64, 0, offset + size, 1)
    return out + struct.pack("<IHHHHIIH", END, 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(size, 0xFFFFFFFF), min(offset, 0xFFFFFFFF), 0)
