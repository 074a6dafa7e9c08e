"""All archive queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coffer.functions import attributes as A
from coffer.functions import names as N
from coffer.operators import batch as B
from coffer.operators import listing as L
from coffer.operators import numbering
from coffer.plans import views as V

QUERIES = {}
ORACLE = {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _adversarial(select: str) -> str:
    return f"WITH {V.ADVERSARIAL_SQL} {select}"


@_query(_adversarial("""
SELECT path, count(*) AS entries, count(*) FILTER (utf8_flagged) AS utf8_flagged, count(*) FILTER (is_junk) AS junk, count(*) FILTER (is_unsafe) AS unsafe, count(*) FILTER (is_symlink) AS symlinks,
  count(*) FILTER (is_directory) AS directories,
  coalesce(array_to_string(list_sort(list(DISTINCT lower(encryption)) FILTER (encryption <> 'none')), ', '), 'none') AS encryption,
  CAST(least(sum(CAST(uncompressed_size AS HUGEINT)), 18446744073709551615) AS BIGINT) AS declared_total
FROM V_adv GROUP BY path"""))
def q01_inspect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.inspect_summary(V.adversarial_view(spark, sf_dir)).withColumn("declared_total", F.col("declared_total").cast("long"))


@_query(_adversarial("""
SELECT path, entry_index, CAST(uncompressed_size AS BIGINT) AS size,
  CASE method WHEN 0 THEN 'store' WHEN 8 THEN 'deflate' WHEN 99 THEN 'aes' ELSE 'method#' || method END AS method,
  CASE encryption WHEN 'none' THEN '-' WHEN 'zipCrypto' THEN 'zipcrypto' ELSE 'aes256/ae-2' END AS encryption,
  CASE WHEN utf8_flagged THEN 'utf8' ELSE '-' END AS name_flag, name
FROM V_adv"""))
def q02_inspect_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.inspect_entries(V.adversarial_view(spark, sf_dir)).withColumn("size", F.col("size").cast("long"))


@_query(_adversarial("SELECT path, entry_index, name FROM V_adv WHERE is_junk"))
def q03_junk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.adversarial_view(spark, sf_dir).where(N.is_junk(F.col("name"))).select("path", "entry_index", "name")


_SAFE_SQL = "CASE WHEN NOT {unsafe} THEN array_to_string(list_filter(string_split(replace({name}, '\\', '/'), '/'), lambda c: c NOT IN ('', '.')), '/') END"


@_query(_adversarial(f"SELECT path, entry_index, name, is_unsafe, {_SAFE_SQL.format(unsafe='is_unsafe', name='name')} AS safe_path FROM V_adv"))
def q04_sanitize_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return V.adversarial_view(spark, sf_dir).select("path", "entry_index", "name", N.is_unsafe(name).alias("is_unsafe"), N.safe_path(name).alias("safe_path"))


@_query(f"""WITH {V.URLS_SQL}, both_names AS (SELECT path, page_id, raw AS name FROM E_url UNION ALL SELECT path, page_id, name FROM E_url),
judged AS (SELECT *, (starts_with(name, '/') OR len(list_filter(string_split(replace(name, '\\', '/'), '/'), lambda c: c = '..' OR contains(c, ':'))) > 0
  OR len(list_filter(string_split(replace(name, '\\', '/'), '/'), lambda c: c NOT IN ('', '.'))) = 0) AS is_unsafe FROM both_names)
SELECT page_id, name, {_SAFE_SQL.format(unsafe='is_unsafe', name='name')} AS safe_path FROM judged""")
def q04b_sanitize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.urls_view(spark, sf_dir)
    both = e.select("page_id", F.col("raw").alias("name")).unionByName(e.select("page_id", "name"))
    return both.withColumn("safe_path", N.safe_path(F.col("name")))


@_query(_adversarial("""
SELECT path, count(*) FILTER (disposition = 'unsafe') AS skipped_unsafe, count(*) FILTER (disposition = 'symlink') AS skipped_symlinks,
  count(*) FILTER (disposition = 'keep' AND is_directory) AS directories, count(*) FILTER (disposition = 'keep' AND NOT is_directory) AS files
FROM D_adv GROUP BY path"""))
def q05_skip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.skip_report(V.adversarial_view(spark, sf_dir))


@_query(_adversarial("SELECT path, entry_index, CAST(coalesce(mode, -1) AS BIGINT) AS mode, is_symlink, is_directory FROM V_adv"))
def q06_unix_mode_symlink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_verdicts(V.adversarial_view(spark, sf_dir)).select("path", "entry_index", F.coalesce("mode", F.lit(-1)).cast("long").alias("mode"), "is_symlink", "is_directory")


@_query(_adversarial("""
SELECT path, entry_index, CAST((mode & 493) | CASE WHEN is_directory THEN 448 ELSE 384 END AS BIGINT) AS extracted_mode, CAST((mode & 511) | CASE WHEN is_directory THEN 448 ELSE 384 END AS BIGINT) AS open_mode
FROM V_adv WHERE mode IS NOT NULL"""))
def q07_extracted_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = L.with_verdicts(V.adversarial_view(spark, sf_dir)).where(F.col("mode").isNotNull())
    mode, directory = F.col("mode"), F.col("is_directory")
    return e.select("path", "entry_index", A.extracted_mode(mode, directory).cast("long").alias("extracted_mode"), A.extracted_mode(mode, directory, 0).cast("long").alias("open_mode"))


@_query("""
SELECT event_id, CAST((least(greatest(year(ts), 1980), 2107) - 1980) * 512 + month(ts) * 32 + day(ts) AS INTEGER) AS dos_date,
  CAST(hour(ts) * 2048 + minute(ts) * 32 + second(ts) // 2 AS INTEGER) AS dos_time FROM events""")
def q08_dos_datetime_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", A.dos_date(F.col("ts")).alias("dos_date"), A.dos_time(F.col("ts")).alias("dos_time"))


@_query("""
SELECT o_orderkey, CAST(make_timestamp(greatest(year(o_orderdate), 1980), month(o_orderdate), day(o_orderdate), hour(o_orderdate), minute(o_orderdate), (second(o_orderdate) // 2) * 2.0) AS VARCHAR) AS restored
FROM orders""")
def q09_dos_datetime_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ts = F.col("o_orderdate")
    return o.select("o_orderkey", A.from_dos(A.dos_date(ts), A.dos_time(ts)).cast("string").alias("restored"))


@_query(f"""WITH {V.DOCUMENTS_SQL}, sized AS (
  SELECT path, CAST(uncompressed_size AS HUGEINT) AS size FROM E_docs
  UNION ALL SELECT path, CAST(9223372036854775808 AS HUGEINT) FROM E_docs WHERE doc_id % 50 = 0)
SELECT path, CAST(least(sum(size), CAST(18446744073709551615 AS HUGEINT)) AS VARCHAR) AS declared_total FROM sized GROUP BY path""")
def q10_declared_total_saturating(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.documents_view(spark, sf_dir)
    hostile = e.where("doc_id % 50 = 0").select("path", F.expr("cast(9223372036854775808 as decimal(20,0))").alias("size"))
    sized = e.select("path", F.col("uncompressed_size").cast("decimal(20,0)").alias("size")).unionByName(hostile)
    return sized.groupBy("path").agg(L.saturating_total(F.col("size")).cast("string").alias("declared_total"))


_LAYOUT_SQL = f"""WITH {V.DOCUMENTS_SQL}, laid AS (
  SELECT *, CAST(coalesce(sum(30 + strlen(name) + compressed_size) OVER (PARTITION BY path ORDER BY entry_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS local_header_offset FROM E_docs)"""


@_query(f"{_LAYOUT_SQL} SELECT path, entry_index, local_header_offset FROM laid")
def q11_writer_layout_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.writer_layout(V.documents_view(spark, sf_dir)).select("path", "entry_index", "local_header_offset")


@_query(f"""WITH {V.DOCUMENTS_SQL} SELECT path, count(*) AS entries, CAST(sum(30 + strlen(name) + compressed_size) AS BIGINT) AS local_bytes,
  CAST(sum(46 + strlen(name)) AS BIGINT) AS central_bytes, CAST(sum(76 + 2 * strlen(name) + compressed_size) + 22 AS BIGINT) AS archive_bytes FROM E_docs GROUP BY path""")
def q12_archive_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.archive_size(V.documents_view(spark, sf_dir))


@_query(f"""{_LAYOUT_SQL}, hostile AS (
  SELECT path, entry_index, name, compressed_size, CASE WHEN doc_id % 97 = 0 AND local_header_offset > 0 THEN local_header_offset - 1 ELSE local_header_offset END AS start FROM laid),
ranges AS (SELECT path, start, start + 30 + strlen(name) + compressed_size AS stop FROM hostile),
prior AS (SELECT *, lag(stop) OVER (PARTITION BY path ORDER BY start, stop) AS before FROM ranges)
SELECT path, count(*) FILTER (coalesce(start < before, false)) AS overlaps, CASE WHEN count(*) FILTER (coalesce(start < before, false)) > 0 THEN 'overlappingEntries' END AS error_code FROM prior GROUP BY path""")
def q13_range_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = L.writer_layout(V.documents_view(spark, sf_dir))
    offset = F.col("local_header_offset")
    hostile = laid.withColumn("local_header_offset", F.when((F.col("doc_id") % 97 == 0) & (offset > 0), offset - 1).otherwise(offset))
    return L.overlap_check(hostile).select("path", "overlaps", "error_code")


@_query(f"""WITH {V.DUPLICATES_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY path, lower(nfc_normalize(name)) ORDER BY entry_index) AS n FROM E_dup)
SELECT path, entry_index, name AS original, CASE WHEN n = 1 THEN name ELSE regexp_replace(name, '\\.txt$', '') || ' ' || n || '.txt' END AS chosen FROM ranked""")
def q14_duplicate_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.number_duplicates(V.duplicates_view(spark, sf_dir))


@_query(f"WITH {V.DUPLICATES_SQL} SELECT path, name, count(*) AS copies FROM E_dup GROUP BY path, name HAVING count(*) > 1")
def q15_duplicate_writer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.duplicate_names(V.duplicates_view(spark, sf_dir))


@_query(_adversarial("""SELECT path, count(DISTINCT list_filter(string_split(replace(name, '\\', '/'), '/'), lambda c: c NOT IN ('', '.'))[1]) AS top_names,
  count(DISTINCT list_filter(string_split(replace(name, '\\', '/'), '/'), lambda c: c NOT IN ('', '.'))[1]) > 1 AS wrap
FROM D_adv WHERE disposition = 'keep' GROUP BY path"""))
def q16_wrapper_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.wrapper_policy(V.adversarial_view(spark, sf_dir))


@_query("""WITH tops AS (SELECT DISTINCT c_mktsegment AS path, n_name AS top, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT path, top, CASE region WHEN 0 THEN top || ' 2' WHEN 1 THEN top || ' 3' ELSE top END AS final FROM tops""")
def q17_toplevel_rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    tops = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(F.col("c_mktsegment").alias("path"), F.col("n_name").alias("top")).distinct()
    existing = nation.where("n_regionkey in (0, 1)").select(F.col("n_name").alias("name"))
    second = nation.where("n_regionkey = 1").select(F.concat("n_name", F.lit(" 2")).alias("name"))
    return numbering.top_level_renames(tops, existing.unionByName(second))


@_query(f"""WITH {V.URLS_SQL}, split AS (SELECT path, list_filter(string_split(replace(name, '\\', '/'), '/'), lambda c: c NOT IN ('', '.')) AS parts FROM E_url
  WHERE len(list_filter(string_split(name, '/'), lambda c: c = '..' OR contains(c, ':'))) = 0 AND NOT starts_with(name, '/')),
levels AS (SELECT path, parts, unnest(generate_series(1, len(parts) - 1)) AS n FROM split WHERE len(parts) > 1)
SELECT DISTINCT path, array_to_string(parts[1:n], '/') AS directory FROM levels""")
def q18_implicit_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.implicit_directories(V.urls_view(spark, sf_dir))


@_query(f"WITH {V.DOCUMENTS_SQL} SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY nfc_normalize(name)) - 1 AS sorted_index FROM E_docs")
def q19_sorted_entry_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sorted_index(V.documents_view(spark, sf_dir)).select("path", "name", F.col("entry_index").alias("sorted_index"))


@_query("""WITH names AS (SELECT conv_id, turn, nfc_normalize(left(text, 24)) AS name FROM conversations)
SELECT conv_id, turn, name, CASE WHEN strlen(name) <> length(name) THEN 2048 ELSE 0 END AS flags, strlen(name) AS name_bytes FROM names""")
def q20_utf8_flag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", N.nfc(F.left("text", F.lit(24))).alias("name"))
    return c.select("conv_id", "turn", "name", F.when(N.needs_utf8_flag(F.col("name")), 2048).otherwise(0).alias("flags"), F.octet_length("name").cast("long").alias("name_bytes"))


# The extensions that are stored, stated apart from the column function.
_STORED = ", ".join(f"'{x}'" for x in "zip gz tgz bz2 xz 7z rar jpg jpeg png gif webp heic heif avif mp4 mov m4v mp3 m4a aac opus".split())


@_query(f"""WITH {V.URLS_SQL}, made AS (SELECT page_id, name || CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '.html' ELSE '' END AS name FROM E_url)
SELECT page_id, name, lower(regexp_extract(list_last(string_split(name, '/')), '^.+\\.([^. /]+)$', 1)) IN ({_STORED}) AS stored FROM made""")
def q21_store_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.urls_view(spark, sf_dir)
    k = F.col("page_id") % 4
    made = e.select("page_id", F.concat("name", F.when(k == 0, ".JPG").when(k == 1, ".tar.gz").when(k == 2, ".html").otherwise("")).alias("name"))
    return made.withColumn("stored", N.stored_by_extension(F.col("name")))


@_query(f"""WITH {V.OUTCOMES_SQL} SELECT batch, count(*) AS requested, count(*) FILTER (NOT failed) AS succeeded, count(*) FILTER (failed) AS failures,
  CAST(coalesce(sum(files) FILTER (NOT failed), 0) AS BIGINT) AS files, CAST(coalesce(sum(directories) FILTER (NOT failed), 0) AS BIGINT) AS directories,
  CAST(coalesce(sum(symlinks) FILTER (NOT failed), 0) AS BIGINT) AS symlinks, count(*) FILTER (NOT failed) = 0 AS total_failure FROM B_out GROUP BY batch""")
def q22_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.batch_summary(V.outcomes_view(spark, sf_dir))


@_query(f"""WITH {V.OUTCOMES_SQL}, lines AS (
  SELECT batch, 'failed' AS note, archive, CAST(archive AS VARCHAR) AS line FROM B_out WHERE failed
  UNION ALL SELECT batch, 'unsafe', archive, unsafe FROM B_out WHERE NOT failed AND unsafe IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY batch, note ORDER BY archive) AS r FROM lines)
SELECT batch, note, string_agg(line, '; ' ORDER BY r) FILTER (r <= 6) AS shown, greatest(count(*) - 6, 0) AS more FROM ranked GROUP BY batch, note""")
def q23_batch_notes_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.batch_notes(V.outcomes_view(spark, sf_dir))


@_query(f"""WITH {V.DOCUMENTS_SQL}, run AS (SELECT path, entry_index, CAST(sum(uncompressed_size) OVER (PARTITION BY path ORDER BY entry_index) AS BIGINT) AS processed,
  CAST(sum(uncompressed_size) OVER (PARTITION BY path) AS BIGINT) AS total FROM E_docs)
SELECT path, entry_index, processed, total, CASE WHEN total = 0 THEN 0 ELSE least(processed * 1000 // total, 1000) END AS permille FROM run""")
def q24_entry_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.progress(V.documents_view(spark, sf_dir)).select("path", "entry_index", "processed", "total", "permille")


_ARCHIVES = "SELECT lang AS batch, source AS archive, CAST(sum(strlen(text)) AS BIGINT) AS size FROM documents GROUP BY lang, source"


@_query(f"""WITH a AS ({_ARCHIVES}), run AS (SELECT batch, archive,
  CAST(coalesce(sum(size) OVER (PARTITION BY batch ORDER BY archive ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
  CAST(sum(size) OVER (PARTITION BY batch) AS BIGINT) AS total FROM a)
SELECT batch, archive, before, total, before * 1000 // total AS permille FROM run""")
def q24b_batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = d.groupBy(F.col("lang").alias("batch"), F.col("source").alias("archive")).agg(F.sum(F.octet_length("text")).cast("long").alias("size"))
    return B.batch_progress(sizes)


@_query(_adversarial("""SELECT path, CAST(sum(uncompressed_size) AS BIGINT) AS required, CAST(67200000 - 67108864 AS BIGINT) AS budget,
  CASE WHEN count(*) FILTER (disposition = 'keep') = 0 THEN 'emptyArchive'
       WHEN bool_or(disposition = 'keep' AND NOT is_directory AND encryption <> 'none') AND path <> 'src1' THEN 'passwordRequired'
       WHEN sum(uncompressed_size) > 91136 THEN 'insufficientSpace' END AS error_code
FROM D_adv GROUP BY path"""))
def q25_space_budget_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.adversarial_view(spark, sf_dir)
    # src1 is free of encryption, so that space decides there
    open_ = e.withColumn("flags", F.when(F.col("path") == "src1", F.col("flags").bitwiseAND(~1)).otherwise(F.col("flags")))
    return L.refusals(open_, F.lit(67_200_000).cast("long")).withColumn("required", F.col("required").cast("long"))


def _crc_steps() -> list[int]:
    """What each low byte does to a CRC-32, from its reflected polynomial."""
    steps = list(range(256))
    for _ in range(8):
        steps = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in steps]
    return steps


@_query(f"""WITH {V.DOCUMENTS_SQL}, octets AS (SELECT path, entry_index, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS octets FROM E_docs)
SELECT path, entry_index, xor(4294967295, list_reduce(octets, lambda c, x: xor(c >> 8, list_extract({_crc_steps()}, xor(c & 255, x) + 1)), 4294967295)) AS crc32 FROM octets""")
def q26_crc32_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.documents_view(spark, sf_dir).select("path", "entry_index", F.crc32(F.col("text").cast("binary")).alias("crc32"))


@_query()
def q27_compressibility_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from coffer.sources.probe import is_worthwhile

    d = V.documents_view(spark, sf_dir).select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content"))
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), F.col("html").cast("binary").alias("content"))
    return d.unionByName(p).select("kind", "id", is_worthwhile("content").alias("worthwhile"))


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, for archives that a query writes; only a ``local`` master may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; it has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="coffer-")
    return f"{found.removeprefix('file://').removeprefix('file:').rstrip('/')}/archives-{uuid.uuid4().hex}"


def _roundtrip(spark: SparkSession, sf_dir: str, password: str | None) -> DataFrame:
    from coffer.sources import archives

    archives.register(spark)
    e = V.documents_view(spark, sf_dir)
    items = e.select(F.concat("path", F.lit(".zip")).alias("archive"), "entry_index", "name", F.col("text").cast("binary").alias("content"), F.lit(0x6F3C).alias("dos_time"), F.lit(0x5B01).alias("dos_date"))
    folder = _scratch(spark)
    os.makedirs(folder, exist_ok=True)
    archives.write_archives(items, folder, password)
    entries = spark.read.format("zip_entries").load(folder)
    names = L.decoded_names(entries).select("path", "entry_index", "name")
    # told of each content before the join, which then moves no content
    text = F.col("content").cast("string")
    got = archives.read_contents(entries, password).select("path", "entry_index", F.col("actual_size").alias("size"), F.md5("content").alias("content_md5"), F.length(text).cast("long").alias("chars"), "status")
    return got.join(names, ["path", "entry_index"]).select("name", "size", "content_md5", "chars", "status")


_ROUNDTRIP_SQL = f"WITH {V.DOCUMENTS_SQL} SELECT name, uncompressed_size AS size, md5(text) AS content_md5, CAST(length(text) AS BIGINT) AS chars, 'ok' AS status FROM E_docs"


@_query(_ROUNDTRIP_SQL)
def q28_zip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, None)


#: Well-formed UTF-8 as pairs of hexadecimal digits, by the table of the Unicode standard.
_UTF8_HEX = "(([0-7].)|(C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|(E[1-9A-CEF])([89AB].){2}|ED[89].[89AB].|F0[9AB].([89AB].){2}|F[1-3]([89AB].){3}|F48.([89AB].){2})*"


# 89EF 9862 are the two characters in CP932.
@_query(f"""WITH named AS (SELECT role AS path, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS entry_index, ' ' || conv_id || '-' || turn || '.txt' AS tail FROM conversations),
raws AS (SELECT *, CASE WHEN path = 'user' THEN '89EF9862' ELSE hex(encode('会話')) END || hex(encode(tail)) AS raw FROM named),
archives AS (SELECT path, CASE WHEN bool_and(regexp_full_match(raw, '{_UTF8_HEX}')) THEN 'utf8' ELSE 'cp932' END AS detected_encoding FROM raws GROUP BY path),
decoded AS (SELECT path, entry_index, detected_encoding, tail, decode(unhex(CASE WHEN detected_encoding = 'cp932' AND starts_with(raw, '89EF9862') THEN hex(encode('会話')) || raw[9:] ELSE raw END)) AS name FROM raws JOIN archives USING (path))
SELECT path, entry_index, detected_encoding, name, name = '会話' || tail AS restored FROM decoded""")
def q29_encoding_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    order = Window.partitionBy("role").orderBy("conv_id", "turn")
    named = F.concat(F.lit("会話 "), "conv_id", F.lit("-"), "turn", F.lit(".txt"))
    e = c.select(F.col("role").alias("path"), (F.row_number().over(order) - 1).cast("long").alias("entry_index"), named.alias("original"))
    raw = F.when(F.col("path") == "user", N.cp932_encode(F.col("original"))).otherwise(F.col("original").cast("binary"))
    return L.decoded_names(e.withColumn("raw_name", raw).withColumn("flags", F.lit(0))).select("path", "entry_index", "detected_encoding", "name", (F.col("name") == F.col("original")).alias("restored"))


@_query(_ROUNDTRIP_SQL)
def q30_encrypted_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, "s3cret-pass")
