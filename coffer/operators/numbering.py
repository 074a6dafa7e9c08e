"""Numbered names for files that would land on one path.

The first claimant of a collision key keeps its name; a later one takes the
first free of "name 2", "name 3"... before the extension, and what it takes is
claimed too. A generated name can only meet names that differ from it in
trailing numbers, so names fall into families: same archive, folder, extension
and stem without trailing numbers. Families without numbered members follow
from a row number; only the others are walked in order, one family at a time.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coffer.functions import names as N


def numbered_name(leaf: str, n: int) -> str:
    found = re.fullmatch(r"(.+)\.([^. /]+)", leaf)
    return f"{found[1]} {n}.{found[2]}" if found else f"{leaf} {n}"


def _walk(family: pd.DataFrame) -> pd.DataFrame:
    """Names of one family in entry order; ``key`` is the collision key of the name."""
    rows = family.sort_values("entry_index")
    claimed: set[str] = set()
    following: dict[str, int] = {}
    chosen = []
    for folder, leaf, key, lowered in zip(rows["folder"], rows["leaf"], rows["key"], rows["key_leaf"], strict=True):
        name = leaf
        if key in claimed:
            # names below the last number taken for this key are claimed already
            n = following.get(key, 2)
            base = key[: len(key) - len(lowered)]
            while base + numbered_name(lowered, n) in claimed:
                n += 1
            following[key] = n + 1
            name, key = numbered_name(leaf, n), base + numbered_name(lowered, n)
        claimed.add(key)
        chosen.append(folder + name)
    return pd.DataFrame({"path": rows["path"], "entry_index": rows["entry_index"], "chosen": chosen})


def number_duplicates(entries: DataFrame) -> DataFrame:
    """(path, entry_index, original, chosen) of every file; ``name`` must be a safe path, directories are exempt."""
    files = entries.where(~F.col("name").endswith("/")).select("path", "entry_index", F.col("name").alias("original"))
    files = files.withColumn("key", N.collision_key(F.col("original")))
    files = files.withColumn("folder", N.parent(F.col("original"))).withColumn("leaf", N.leaf(F.col("original"))).withColumn("key_leaf", N.leaf(F.col("key")))
    bare = F.regexp_replace(N.stem(F.col("key_leaf")), r"( [0-9]+)+$", "")
    files = files.withColumn("family", F.concat_ws("\u0000", N.parent(F.col("key")), bare, N.extension(F.col("key_leaf"))))
    named = (N.stem(F.col("key_leaf")) != bare).cast("int")
    families = files.groupBy("path", "family").agg(F.max(named).alias("has_numbers"), F.count("*").alias("n"), F.count_distinct("key").alias("keys"))
    walked = families.where("has_numbers = 1 and n > keys").select("path", "family")
    simple = files.join(walked, ["path", "family"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("path", "key").orderBy("entry_index"))
    simple = simple.withColumn("turn", turn).select("path", "entry_index", F.when(F.col("turn") == 1, F.col("original")).otherwise(F.concat("folder", N.numbered(F.col("leaf"), F.col("turn")))).alias("chosen"))
    kind = dict(entries.dtypes)
    hard = files.join(walked, ["path", "family"]).groupBy("path", "family").applyInPandas(_walk, f"path {kind['path']}, entry_index {kind['entry_index']}, chosen string")
    return files.select("path", "entry_index", "original").join(simple.unionByName(hard), ["path", "entry_index"])


def _claim(group: pd.DataFrame) -> list[str]:
    """Final names of one family in the order of its rows."""
    held = set()
    for names in group["claimed"]:
        held.update(names if names is not None else ())
    final = []
    for name in group["name"]:
        n, out = 2, name
        while out in held:
            out, n = numbered_name(name, n), n + 1
        held.add(out)
        final.append(out)
    return final


def _families(tops: DataFrame, existing: DataFrame) -> DataFrame:
    bare = F.regexp_replace(N.stem(F.col("name")), r"( [0-9]+)+$", "")
    family = F.concat_ws("\u0000", bare, N.extension(F.col("name")))
    claimed = existing.select("name").distinct().withColumn("family", family).groupBy("family").agg(F.array_sort(F.collect_list("name")).alias("claimed"))
    return tops.select("path", F.col("top").alias("name")).withColumn("family", family).join(claimed, "family", "left")


def top_level_renames(tops: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, top, final): each archive's top-level names made unique against ``existing`` (name) and each other, in sorted order.

    Names compare exactly. Families go as in :func:`number_duplicates`, with the
    existing names claimed first.
    """

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("name")
        return pd.DataFrame({"path": group["path"], "top": group["name"], "final": _claim(group)})

    kind = dict(tops.dtypes)["path"]
    return _families(tops, existing).groupBy("path", "family").applyInPandas(assign, f"path {kind}, top string, final string")


def shared_renames(tops: DataFrame, existing: DataFrame) -> DataFrame:
    """Like :func:`top_level_renames` for archives that share one destination: names are claimed in order of archive."""

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["path", "name"])
        return pd.DataFrame({"path": group["path"], "top": group["name"], "final": _claim(group)})

    kind = dict(tops.dtypes)["path"]
    return _families(tops, existing).groupBy("family").applyInPandas(assign, f"path {kind}, top string, final string")
