"""Honest and hostile archives, built from the format note alone."""

import struct
import zlib


def local(name, body, method=0, flags=0, crc=None, full=None, time=0x6F3C, date=0x5B01):
    return struct.pack("<IHHHHHIIIHH", 0x04034B50, 20, flags, method, time, date, zlib.crc32(body) if crc is None else crc, len(body), len(body) if full is None else full, len(name), 0) + name + body


def central(name, packed, full, crc, offset, method=0, flags=0, made=788, attributes=0o100644 << 16, extra=b"", time=0x6F3C, date=0x5B01):
    return struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, made, 20, flags, method, time, date, crc, packed, full, len(name), len(extra), 0, 0, 0, attributes, offset) + name + extra


def end(count, size, offset):
    return struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, size, offset, 0)


def archive(files, flags=0):
    """Stored files in order: [(name bytes, body)]."""
    body, directory = b"", b""
    for name, content in files:
        directory += central(name, len(content), len(content), zlib.crc32(content), len(body), flags=flags)
        body += local(name, content, flags=flags)
    return body + directory + end(len(files), len(directory), len(body))


def size_lie():
    """Declares 1024 bytes, inflates to 8 MiB of zeros."""
    engine = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = engine.compress(bytes(8 << 20)) + engine.flush()
    body = local(b"bomb.bin", packed, 8, crc=0, full=1024)
    directory = central(b"bomb.bin", len(packed), 1024, 0, 0, method=8)
    return body + directory + end(1, len(directory), len(body))


def overlap(n=20):
    body = local(b"copy000.bin", bytes(1000))
    directory = b"".join(central(b"copy%03d.bin" % i, 1000, 1000, zlib.crc32(bytes(1000)), 0) for i in range(n))
    return body + directory + end(n, len(directory), len(body))


def truncated():
    body = local(b"a.bin", b"12345678", full=1 << 20)
    directory = central(b"a.bin", 1 << 20, 1 << 20, 0, 0)
    return body + directory + end(1, len(directory), len(body))


def locator_underflow():
    return end(0xFFFF, 0, 0)


def zip64_overflow():
    record = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, 1, 1, 2**64 - 256, 256)
    return record + struct.pack("<IIQI", 0x07064B50, 0, 0, 1) + end(0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF)


def declared_wrap():
    """Two entries of 16 bytes that each declare 2**63."""
    body, directory = b"", b""
    for name in (b"a", b"b"):
        extra = struct.pack("<HHQ", 1, 8, 2**63)
        directory += central(name, 16, 0xFFFFFFFF, 0, len(body), extra=extra)
        body += local(name, bytes(16))
    return body + directory + end(2, len(directory), len(body))
