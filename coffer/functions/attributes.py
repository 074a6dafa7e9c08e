"""Header fields as columns: methods, encryption, modes, DOS times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORE, DEFLATE, AES = 0, 8, 99
ENCRYPTED, DESCRIPTOR, UTF8_NAME = 1, 8, 2048
#: Host systems whose upper attribute bits are a Unix mode: Unix and macOS.
UNIX_HOSTS = (3, 19)


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def is_directory(name: Column) -> Column:
    return name.endswith("/")


def is_directory_bytes(raw_name: Column) -> Column:
    """The last raw byte is a slash."""
    return F.substring(F.hex(raw_name), -2, 2) == "2F"


def unix_mode(version_made_by: Column, external_attributes: Column) -> Column:
    """The Unix mode, null if the host is another or the mode is 0."""
    mode = F.shiftright(external_attributes.cast("long"), 16).bitwiseAND(0xFFFF).cast("int")
    return F.when(F.shiftright(version_made_by.cast("int"), 8).isin(*UNIX_HOSTS), F.nullif(mode, F.lit(0)))


def is_symlink(mode: Column) -> Column:
    return F.coalesce(mode.bitwiseAND(0xF000) == 0xA000, F.lit(False))


def extracted_mode(mode: Column, directory: Column, umask: int = 0o022) -> Column:
    """Permission bits under ``umask``; the owner can always read and write, and enter folders."""
    floor = F.when(directory, 0o700).otherwise(0o600)
    return mode.bitwiseAND(0o777 & ~umask).bitwiseOR(floor)


def dos_date(ts: Column) -> Column:
    """Year clamped to 1980..2107; month and day as they are."""
    year = F.greatest(F.least(F.year(ts), F.lit(2107)), F.lit(1980))
    return ((year - 1980) * 512 + F.month(ts) * 32 + F.dayofmonth(ts)).cast("int")


def dos_time(ts: Column) -> Column:
    return (F.hour(ts) * 2048 + F.minute(ts) * 32 + F.floor(F.second(ts) / 2)).cast("int")


def from_dos(date: Column, time: Column) -> Column:
    """The time without zone; null where month, day or time of day is impossible."""
    date, time = date.cast("int"), time.cast("int")
    return F.try_make_timestamp_ntz(
        F.shiftright(date, 9) + 1980, F.shiftright(date, 5).bitwiseAND(15), date.bitwiseAND(31),
        F.shiftright(time, 11), F.shiftright(time, 5).bitwiseAND(63), (time.bitwiseAND(31) * 2).cast("decimal(16,6)"),
    )


def method_label(method: Column) -> Column:
    return F.when(method == STORE, "store").when(method == DEFLATE, "deflate").when(method == AES, "aes").otherwise(F.concat(F.lit("method#"), method.cast("string")))


def encryption_kind(flags: Column, method: Column) -> Column:
    """none, zipCrypto or aes; method 99 without the encrypted bit stays none."""
    return F.when(~has_flag(flags, ENCRYPTED), "none").when(method == AES, "aes").otherwise("zipCrypto")


def encryption_label(kind: Column, bits: Column, vendor: Column) -> Column:
    return F.when(kind == "none", "-").when(kind == "zipCrypto", "zipcrypto").otherwise(F.concat(F.lit("aes"), bits.cast("string"), F.lit("/ae-"), vendor.cast("string")))
