"""Entry names: junk, safety, normal forms, code pages, numbering.

All but the Unicode and CP932 functions are Spark columns.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# macOS metadata names that archives should not carry.
JUNK_NAMES = (".DS_Store", "__MACOSX", "Icon\r", ".fseventsd", ".Spotlight-V100", ".Trashes")
JUNK_PREFIX = "._"

# Extensions of formats that are compressed already.
STORED_EXTENSIONS = (
    "zip", "gz", "tgz", "bz2", "xz", "7z", "rar",
    "jpg", "jpeg", "png", "gif", "webp", "heic", "heif", "avif",
    "mp4", "mov", "m4v", "mp3", "m4a", "aac", "opus",
)


@pandas_udf(T.StringType())
def nfc(names: pd.Series) -> pd.Series:
    """Unicode NFC of each name; null stays null."""
    return names.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s), na_action="ignore")


@pandas_udf(T.StringType())
def cp932_decode(raw: pd.Series) -> pd.Series:
    """Text of CP932 bytes, null where they are invalid."""

    def one(b):
        try:
            return None if b is None else bytes(b).decode("cp932")
        except UnicodeDecodeError:
            return None

    return raw.map(one)


@pandas_udf(T.BinaryType())
def cp932_encode(names: pd.Series) -> pd.Series:
    """CP932 bytes of the NFC name, null where it cannot be mapped."""

    def one(s):
        try:
            return None if s is None else unicodedata.normalize("NFC", s).encode("cp932")
        except UnicodeEncodeError:
            return None

    return names.map(one)


def is_junk(name: Column) -> Column:
    """Any component is a macOS metadata name or starts with ``._``."""
    return F.exists(F.split(name, "/"), lambda c: c.isin(*JUNK_NAMES) | c.startswith(JUNK_PREFIX))


def unified(name: Column) -> Column:
    return F.translate(name, "\\", "/")


def is_unsafe(name: Column) -> Column:
    """The name is absolute, climbs, holds a drive or stream mark, or has nothing left."""
    parts = F.split(unified(name), "/")
    return unified(name).startswith("/") | F.exists(parts, lambda c: (c == "..") | c.contains(":")) | (F.size(F.filter(parts, lambda c: ~c.isin("", "."))) == 0)


def safe_components(name: Column) -> Column:
    """array<string> of the components that would be written, null if the name is unsafe."""
    kept = F.filter(F.split(unified(name), "/"), lambda c: ~c.isin("", "."))
    return F.when(~is_unsafe(name), kept)


def safe_path(name: Column) -> Column:
    return F.array_join(safe_components(name), "/")


def extension(leaf: Column) -> Column:
    """What follows the last dot; empty for hidden files, trailing dots, and endings with a space."""
    return F.regexp_extract(leaf, r"^.+\.([^. /]+)$", 1)


def stem(leaf: Column) -> Column:
    return F.when(extension(leaf) == "", leaf).otherwise(F.regexp_extract(leaf, r"^(.+)\.[^. /]+$", 1))


def numbered(leaf: Column, n: Column) -> Column:
    """``name n.ext``."""
    ext = extension(leaf)
    return F.concat(stem(leaf), F.lit(" "), n.cast("string"), F.when(ext == "", F.lit("")).otherwise(F.concat(F.lit("."), ext)))


def parent(path: Column) -> Column:
    """The path without its leaf, with its trailing slash; empty at the top."""
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def collision_key(path: Column) -> Column:
    """Names with equal keys land on one file where case and normal form do not count."""
    return F.lower(nfc(path))


def stored_by_extension(path: Column) -> Column:
    return F.lower(extension(leaf(path))).isin(*STORED_EXTENSIONS)


def needs_utf8_flag(name: Column) -> Column:
    """The name has a character beyond ASCII."""
    return F.octet_length(name) != F.char_length(name)
