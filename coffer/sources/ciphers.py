"""Entry encryption: the traditional cipher and the AES form of the published extension.

AES blocks run in numpy, all counters of a chunk at once; its substitution table
follows from the field's inverse, not from a list.
"""

from __future__ import annotations

import hashlib
import hmac
import os
from collections.abc import Callable, Iterator

import numpy as np

from coffer.sources.zipfile_format import ZipError

Chunks = Callable[[int, int], Iterator[bytes]]
ROUNDS, CODE_BYTES = 1000, 10

# --------------------------------------------------------------------------
# The traditional cipher: three 32-bit keys fed with every plain byte.

class _Traditional:
    def __init__(self, password: bytes):
        self.keys = [0x12345678, 0x23456789, 0x34567890]
        for b in password:
            self._feed(b)

    def _feed(self, b: int) -> None:
        a, c, d = self.keys
        a = (a >> 8) ^ _table(a ^ b)
        c = ((c + (a & 0xFF)) * 134775813 + 1) & 0xFFFFFFFF
        d = (d >> 8) ^ _table(d ^ (c >> 24))
        self.keys = [a, c, d]

    def run(self, data: bytes, encrypt: bool) -> bytes:
        out = bytearray(len(data))
        for i, b in enumerate(data):
            t = (self.keys[2] | 2) & 0xFFFF
            out[i] = b ^ ((t * (t ^ 1)) >> 8 & 0xFF)
            self._feed(b if encrypt else out[i])
        return bytes(out)


def _build_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


_TABLE = _build_table()


def _table(value: int) -> int:
    return _TABLE[value & 0xFF]


def zipcrypto_opened(chunks: Chunks, at: int, size: int, password: str, check: int) -> Iterator[bytes]:
    if size < 12:
        raise ZipError("corrupt", "encryption header")
    cipher = _Traditional(password.encode())
    if cipher.run(next(chunks(at, 12)), encrypt=False)[-1] != check & 0xFF:
        raise ZipError("wrongPassword")
    return (cipher.run(c, encrypt=False) for c in chunks(at + 12, size - 12))


def zipcrypto_sealed(payload: bytes, password: str, check: int) -> bytes:
    cipher = _Traditional(password.encode())
    return cipher.run(os.urandom(11) + bytes([check & 0xFF]), encrypt=True) + cipher.run(payload, encrypt=True)


# --------------------------------------------------------------------------
# AES in the extension's counter mode.


def _field_tables() -> tuple[np.ndarray, np.ndarray]:
    """(substitution table, doubling table) of the AES field."""
    powers, logs, x = [], {}, 1
    for i in range(255):
        powers.append(x)
        logs[x] = i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    sub = np.zeros(256, np.uint8)
    for v in range(256):
        inverse = powers[(255 - logs[v]) % 255] if v else 0
        turned = inverse
        for k in range(1, 5):
            turned ^= (inverse << k | inverse >> 8 - k) & 0xFF
        sub[v] = turned ^ 0x63
    double = np.array([(v << 1 ^ (0x1B if v & 0x80 else 0)) & 0xFF for v in range(256)], np.uint8)
    return sub, double


_SUB, _DOUBLE = _field_tables()
#: Row r of the column-major state moves r columns.
_SHIFT = np.array([(4 * (i // 4 + i % 4) + i % 4) % 16 for i in range(16)])


def _mixed() -> np.ndarray:
    """Substitution and column mixing in one: what a byte of each row adds to its column, as four bytes in a word."""
    once, twice = _SUB, _DOUBLE[_SUB]
    first = [twice, once, once, once ^ twice]
    return np.concatenate([np.ascontiguousarray(np.stack([first[(i - row) % 4] for i in range(4)], axis=1)).view(np.uint32).ravel() for row in range(4)])


_MIXED = _mixed()
#: Where a row's words begin in the table.
_ROW = np.tile(np.arange(4, dtype=np.uint16) * 256, 4)


def _round_keys(key: bytes) -> np.ndarray:
    n, words, constant = len(key) // 4, [list(key[i : i + 4]) for i in range(0, len(key), 4)], 1
    for i in range(n, 4 * (n + 7)):
        word = list(words[-1])
        if i % n == 0:
            word = [int(_SUB[b]) for b in word[1:] + word[:1]]
            word[0] ^= constant
            constant = int(_DOUBLE[constant])
        elif n > 6 and i % n == 4:
            word = [int(_SUB[b]) for b in word]
        words.append([a ^ b for a, b in zip(words[i - n], word, strict=True)])
    return np.array(words, np.uint8).reshape(-1, 16)


def aes_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    """Encrypts (n, 16) bytes, each row a block."""
    keys = _round_keys(key)
    state = blocks ^ keys[0]
    for k in keys[1:-1]:
        t = _MIXED[state[:, _SHIFT] + _ROW].reshape(-1, 4, 4)
        words = t[:, :, 0] ^ t[:, :, 1] ^ t[:, :, 2] ^ t[:, :, 3] ^ k.view(np.uint32)
        state = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 16)
    return _SUB[state][:, _SHIFT] ^ keys[-1]


class _Counter:
    """Key stream of blocks numbered from 1, little-endian."""

    def __init__(self, key: bytes):
        self.key, self.next, self.rest = key, 1, np.zeros(0, np.uint8)

    def run(self, data: bytes) -> bytes:
        need = len(data) - len(self.rest)
        if need > 0:
            n = -(-need // 16)
            counters = np.zeros((n, 2), "<u8")
            counters[:, 0] = np.arange(self.next, self.next + n, dtype=np.uint64)
            self.next += n
            self.rest = np.concatenate([self.rest, aes_blocks(self.key, counters.view(np.uint8).reshape(n, 16)).ravel()])
        used, self.rest = self.rest[: len(data)], self.rest[len(data) :]
        return (np.frombuffer(data, np.uint8) ^ used).tobytes()


def _derived(password: str, salt: bytes, size: int) -> tuple[bytes, bytes, bytes]:
    made = hashlib.pbkdf2_hmac("sha1", password.encode(), salt, ROUNDS, 2 * size + 2)
    return made[:size], made[size : 2 * size], made[2 * size :]


def aes_opened(chunks: Chunks, at: int, size: int, password: str, key_bytes: int) -> Iterator[bytes]:
    """Plain chunks; after the last one the authentication code is checked."""
    salt_bytes = key_bytes // 2
    if size < salt_bytes + 2 + CODE_BYTES:
        raise ZipError("corrupt", "AES data too short")
    head = next(chunks(at, salt_bytes + 2))
    key, code_key, verifier = _derived(password, head[:salt_bytes], key_bytes)
    if not hmac.compare_digest(verifier, head[salt_bytes:]):
        raise ZipError("wrongPassword")
    code, counter = hmac.new(code_key, digestmod="sha1"), _Counter(key)

    def plain() -> Iterator[bytes]:
        start, left = at + salt_bytes + 2, size - salt_bytes - 2 - CODE_BYTES
        for chunk in chunks(start, left):
            code.update(chunk)
            yield counter.run(chunk)
        if not hmac.compare_digest(code.digest()[:CODE_BYTES], next(chunks(start + left, CODE_BYTES))):
            raise ZipError("authenticationFailed")

    return plain()


def aes_sealed(payload: bytes, password: str, method: int) -> tuple[bytes, bytes]:
    """(salt, verifier, data and code; the extra field of AE-2 with 256 bits)."""
    import struct

    salt = os.urandom(16)
    key, code_key, verifier = _derived(password, salt, 32)
    data = _Counter(key).run(payload)
    extra = struct.pack("<HHH2sBH", 0x9901, 7, 2, b"AE", 3, method)
    return salt + verifier + data + hmac.new(code_key, data, "sha1").digest()[:CODE_BYTES], extra
