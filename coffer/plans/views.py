"""Deterministic archive views over the driver tables, in Spark and in SQL.

They are fixtures for the archive rules: paths, flags and modes follow from row
ids, so that every rule meets rows that break it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain archives: one for each source, an entry for each document, stored."""
    d = _table(spark, sf_dir, "documents")
    order = Window.partitionBy("source").orderBy("doc_id")
    size = F.octet_length("text").cast("long")
    return d.select(
        F.col("source").alias("path"), (F.row_number().over(order) - 1).cast("long").alias("entry_index"), F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("name"),
        size.alias("compressed_size"), size.alias("uncompressed_size"), "doc_id", "text",
    )


DOCUMENTS_SQL = """E_docs AS (
  SELECT source AS path, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS entry_index,
         source || '/' || lang || '/' || doc_id || '.txt' AS name,
         CAST(strlen(text) AS BIGINT) AS compressed_size, CAST(strlen(text) AS BIGINT) AS uncompressed_size, doc_id, text
  FROM documents)"""


def adversarial_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives whose entries break the rules in turn, by ``doc_id % 16``; every fifth comes from a DOS host, every seventh is encrypted."""
    d = _table(spark, sf_dir, "documents")
    doc, kind = F.col("doc_id"), F.col("doc_id") % 16
    folder = F.concat("source", F.lit("/"), "lang", F.lit("/"))
    base = F.concat(folder, doc, F.lit(".txt"))
    name = (
        F.when(kind == 0, F.concat(F.lit("__MACOSX/"), base))
        .when(kind == 1, F.concat(folder, F.lit("._"), doc, F.lit(".txt")))
        .when(kind == 2, F.concat("source", F.lit("/"), doc, F.lit("/.DS_Store")))
        .when(kind.isin(3, 8), F.concat(F.lit("../"), base))
        .when(kind == 4, F.concat(F.lit("C:\\"), F.translate(base, "/", "\\")))
        .when(kind == 5, F.concat(F.lit("./"), base))
        .when(kind == 6, F.translate(base, "/", "\\"))
        .when(kind == 9, F.concat(base, F.lit(":ads")))
        .when(kind == 10, F.concat(F.lit("/"), base))
        .when(kind == 11, F.concat(folder, doc, F.lit("/")))
        .when(kind == 12, F.concat(folder, F.lit("デ"), doc, F.lit(".txt")))
        .otherwise(base)
    )
    mode = F.when(kind.isin(7, 8), 0o120777).when(kind == 11, 0o040755).otherwise(0o100000 + doc % 512)
    size = F.octet_length("text").cast("long")
    locked = doc % 7 == 0
    return d.select(
        F.col("source").alias("path"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long").alias("entry_index"), name.alias("name"),
        (F.when(kind == 12, 2048).otherwise(0) + F.when(locked, 1).otherwise(0)).alias("flags"),
        F.when(locked & (doc % 2 == 0), 99).when(doc % 11 == 0, 0).when(doc % 13 == 0, 12).otherwise(8).alias("method"),
        F.when(doc % 5 == 0, 20).otherwise(788).alias("version_made_by"), (mode * 65536 + F.when(kind == 11, 16).otherwise(32)).cast("long").alias("external_attributes"),
        size.alias("compressed_size"), size.alias("uncompressed_size"), "doc_id",
    )


ADVERSARIAL_SQL = """base0 AS (
  SELECT *, source || '/' || lang || '/' AS folder, source || '/' || lang || '/' || doc_id || '.txt' AS base, doc_id % 16 AS kind FROM documents),
E_adv AS (
  SELECT source AS path, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS entry_index,
    CASE WHEN kind = 0 THEN '__MACOSX/' || base WHEN kind = 1 THEN folder || '._' || doc_id || '.txt' WHEN kind = 2 THEN source || '/' || doc_id || '/.DS_Store'
         WHEN kind IN (3, 8) THEN '../' || base WHEN kind = 4 THEN 'C:\\' || replace(base, '/', '\\') WHEN kind = 5 THEN './' || base
         WHEN kind = 6 THEN replace(base, '/', '\\') WHEN kind = 9 THEN base || ':ads' WHEN kind = 10 THEN '/' || base
         WHEN kind = 11 THEN folder || doc_id || '/' WHEN kind = 12 THEN folder || 'デ' || doc_id || '.txt' ELSE base END AS name,
    CASE WHEN kind = 12 THEN 2048 ELSE 0 END + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS flags,
    CASE WHEN doc_id % 7 = 0 AND doc_id % 2 = 0 THEN 99 WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN 12 ELSE 8 END AS method,
    CASE WHEN doc_id % 5 = 0 THEN 20 ELSE 788 END AS version_made_by,
    CAST((CASE WHEN kind IN (7, 8) THEN 41471 WHEN kind = 11 THEN 16877 ELSE 32768 + doc_id % 512 END) * 65536 + CASE WHEN kind = 11 THEN 16 ELSE 32 END AS BIGINT) AS external_attributes,
    CAST(strlen(text) AS BIGINT) AS compressed_size, CAST(strlen(text) AS BIGINT) AS uncompressed_size, doc_id
  FROM base0),
V_adv AS (
  SELECT *, ends_with(name, '/') AS is_directory,
    CASE WHEN (version_made_by >> 8) IN (3, 19) THEN nullif((external_attributes >> 16) & 65535, 0) END AS mode,
    coalesce(CASE WHEN (version_made_by >> 8) IN (3, 19) THEN ((external_attributes >> 16) & 61440) = 40960 END, false) AS is_symlink,
    len(list_filter(string_split(name, '/'), lambda c: c IN ('.DS_Store', '__MACOSX', 'Icon' || chr(13), '.fseventsd', '.Spotlight-V100', '.Trashes') OR starts_with(c, '._'))) > 0 AS is_junk,
    (starts_with(replace(name, '\\', '/'), '/')
      OR len(list_filter(string_split(replace(name, '\\', '/'), '/'), lambda c: c = '..' OR contains(c, ':'))) > 0
      OR len(list_filter(string_split(replace(name, '\\', '/'), '/'), lambda c: c NOT IN ('', '.'))) = 0) AS is_unsafe,
    (flags & 2048) <> 0 AS utf8_flagged,
    CASE WHEN (flags & 1) = 0 THEN 'none' WHEN method = 99 THEN 'aes' ELSE 'zipCrypto' END AS encryption
  FROM E_adv),
D_adv AS (SELECT *, CASE WHEN is_unsafe THEN 'unsafe' WHEN is_symlink THEN 'symlink' ELSE 'keep' END AS disposition FROM V_adv)"""


def duplicates_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives by brand whose file names are part names, many of them alike."""
    p = _table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("entry_index"), F.concat("p_name", F.lit(".txt")).alias("name"))


DUPLICATES_SQL = "E_dup AS (SELECT p_brand AS path, p_partkey AS entry_index, p_name || '.txt' AS name FROM part)"


def urls_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archive of all page addresses, as they are (``raw``) and without their scheme (``name``)."""
    g = _table(spark, sf_dir, "pages")
    return g.select(F.lit("pages").alias("path"), "page_id", F.col("url").alias("raw"), F.regexp_replace("url", "^[a-z]+://", "").alias("name"))


URLS_SQL = "E_url AS (SELECT 'pages' AS path, page_id, url AS raw, regexp_replace(url, '^[a-z]+://', '') AS name FROM pages)"


def outcomes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extraction outcome for each document: quality 0 failed, toxic entries had unsafe paths."""
    d, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    joined = d.select("doc_id", "source").join(labels, "doc_id", "left")
    doc = F.col("doc_id")
    return joined.select(
        F.col("source").alias("batch"), doc.alias("archive"), (F.coalesce("quality", F.lit(1)) == 0).alias("failed"),
        (1 + doc % 9).alias("files"), (doc % 4).alias("directories"), (doc % 3).alias("symlinks"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("../"), doc, F.lit(".txt"))).alias("unsafe"),
    )


OUTCOMES_SQL = """B_out AS (
  SELECT d.source AS batch, d.doc_id AS archive, coalesce(l.quality, 1) = 0 AS failed, 1 + d.doc_id % 9 AS files, d.doc_id % 4 AS directories,
         d.doc_id % 3 AS symlinks, CASE WHEN l.toxic = 1 THEN '../' || d.doc_id || '.txt' END AS unsafe
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
