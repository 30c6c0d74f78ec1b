"""Queries of the archive engine and their SQL.

Each query reads whole tables. ORACLES holds the same result in DuckDB SQL where SQL can say it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarc.functions import codecs, paths, scalars, transforms
from stratarc.functions.classify import by_rules, classified, exec_transform, has_compressed_magic
from stratarc.operators import blocks as bl
from stratarc.operators import dedup, encodings, rollup, select, trees, verify
from stratarc.operators.chunking import chunked, fixed_chunks
from stratarc.operators.ordered import numbered
from stratarc.operators.reassemble import joined, needed_blocks
from stratarc.operators.scratch import shared_dir, written
from stratarc.sources import archive, views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

FIXED, BLOCK = 512, 65_536
CDC = {"least": 256, "bits": 10, "most": 4096}

_FILES = """files AS (
  SELECT doc_id AS file_id, lang, 'documents/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, encode(coalesce(text, '')) AS content,
    CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, (doc_id * 7919) % 2000003 - 1000001 AS mtime_s, CAST((doc_id * 1000003) % 1000000000 AS INTEGER) AS mtime_ns
  FROM documents)"""
_REFS = f"""{_FILES}, cut AS (SELECT file_id, path, size, hex(content) AS hx, unnest(range(0, size, {FIXED})) AS offs FROM files),
refs AS (
  SELECT file_id, path, CAST(offs // {FIXED} AS INTEGER) AS ref_pos, least({FIXED}, size - offs) AS chunk_len, sha256(unhex(substr(hx, offs * 2 + 1, {FIXED * 2}))) AS chunk_hash FROM cut),
firsts AS (SELECT chunk_hash, min((file_id, ref_pos)) AS f, any_value(chunk_len) AS chunk_len FROM refs GROUP BY chunk_hash),
chunks AS (SELECT chunk_hash, chunk_len, row_number() OVER (ORDER BY f) - 1 AS chunk_id FROM firsts)"""
_PACKED = f"""{_REFS}, fold AS (
  SELECT 0::BIGINT AS chunk_id, (SELECT chunk_len FROM chunks WHERE chunk_id = 0) AS used, 0::BIGINT AS block_id WHERE EXISTS (SELECT 1 FROM chunks)
  UNION ALL
  SELECT c.chunk_id, CASE WHEN f.used + c.chunk_len > {BLOCK} THEN c.chunk_len ELSE f.used + c.chunk_len END, f.block_id + CASE WHEN f.used + c.chunk_len > {BLOCK} THEN 1 ELSE 0 END
  FROM fold f JOIN chunks c ON c.chunk_id = f.chunk_id + 1),
packed AS (SELECT c.chunk_id, c.chunk_len, c.chunk_hash, f.block_id FROM fold f JOIN chunks c ON c.chunk_id = f.chunk_id)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.documents(spark, sf_dir)


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _docs(spark, sf_dir)
    return fixed_chunks(files.select("file_id", "content"), FIXED).join(files.select("file_id", "path"), "file_id")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with block_id, refs with chunk_id) of fixed chunks of all documents."""
    refs = written(_refs(spark, sf_dir), "refs")
    chunks, linked = dedup.with_ids(refs, ["file_id", "ref_pos"])
    packed = bl.pack_blocks(chunks.select("chunk_id", "chunk_len", "chunk_hash", F.lit(False).alias("store_group")), BLOCK)
    return written(packed, "packed"), linked


# Listing and selection


@query(f"""WITH {_FILES} SELECT path, size, CASE WHEN size >= 1048576 THEN printf('%.2f MiB', size / 1048576.0::DOUBLE) WHEN size >= 1024 THEN printf('%.2f KiB', size / 1024.0::DOUBLE) ELSE size || ' B' END AS human_size,
strftime(make_timestamp(mtime_s * 1000000), '%Y-%m-%d %H:%M') AS modified, '0644' AS mode FROM files""")
def list_entries(spark, sf_dir):
    return _docs(spark, sf_dir).select("path", "size", scalars.human(F.col("size")).alias("human_size"), scalars.civil(F.col("mtime_s")).alias("modified"), scalars.octal(F.col("mode")).alias("mode"))


@query("SELECT 'documents/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, doc_id AS file_id FROM documents WHERE doc_id = 7")
def find_entry(spark, sf_dir):
    path = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id = 7").select(F.concat(F.lit("documents/"), "lang", F.lit("/"), "source", F.lit("/7.txt"))).first()
    return views.find_document(spark, sf_dir, path[0]).select("path", "file_id")


_PREFIXES = ["documents/en/src1", "documents/en/", "documents/fr/src3/"]


@query(f"WITH {_FILES} SELECT DISTINCT path, size FROM files WHERE starts_with(path, 'documents/en/src1/') OR starts_with(path, 'documents/en/') OR starts_with(path, 'documents/fr/src3/')")
def prefix_select(spark, sf_dir):
    return select.prefix_select(_docs(spark, sf_dir), _PREFIXES, strict=False).select("path", "size")


@query(f"""WITH {_FILES}, f(filter) AS (VALUES ('documents/en/'), ('documents/xx'), ('docum'), ('documents'))
SELECT filter FROM f WHERE NOT EXISTS (SELECT 1 FROM files WHERE path = rtrim(filter, '/') OR starts_with(path, rtrim(filter, '/') || '/'))""")
def unmatched_filters(spark, sf_dir):
    filters = spark.createDataFrame([("documents/en/",), ("documents/xx",), ("docum",), ("documents",)], "filter string")
    return select.unmatched(_docs(spark, sf_dir), filters)


@query("""WITH p AS (SELECT 'documents/' || lang || '/' || source || '/' || doc_id || '.txt' AS path FROM documents UNION ALL SELECT 'pages/' || page_id || '.html' FROM pages
UNION ALL SELECT 'conversations/' || conv_id || '/' || turn || '-' || role || '.md' FROM conversations UNION ALL SELECT 'benchmark/' || item_id || '.txt' FROM benchmark),
k AS (SELECT path, regexp_extract(path, '\\.([^.]*)$', 1) AS ext, regexp_extract(path, '[^/]*$') AS base FROM p)
SELECT path, ext, row_number() OVER (ORDER BY ext, base, path) - 1 AS storage_pos FROM k""")
def storage_order(spark, sf_dir):
    # ranging reads its input twice, so contents are classified into a slim table first
    files = written(classified(views.corpus(spark, sf_dir)).select("path", "class", "transform", "size"), "classes")
    return archive.in_storage_order(files).select("path", paths.extension(F.col("path")).alias("ext"), "storage_pos")


@query("""SELECT type_name, count(*) AS entries, CAST(sum(bytes) AS BIGINT) AS logical_bytes FROM (
SELECT 'file' AS type_name, octet_length(encode(text)) AS bytes FROM documents UNION ALL SELECT 'file', octet_length(encode(html)) FROM pages) GROUP BY type_name""")
def type_counts(spark, sf_dir):
    return rollup.type_counts(views.documents(spark, sf_dir).unionByName(views.pages(spark, sf_dir)))


@query(f"""WITH {_FILES} SELECT path, '{{"path":"' || path || '","type":0,"mtime_s":' || mtime_s || ',"mtime_ns":' || mtime_ns || ',"size":' || size || '}}' AS json FROM files""")
def entries_json(spark, sf_dir):
    return _docs(spark, sf_dir).select("path", F.to_json(F.struct("path", "type", "mtime_s", "mtime_ns", "size")).alias("json"))


# Predicates and classes

_BAD = "regexp_matches(p, '(^|/)(\\.|\\.\\.)?(/|$)')"


@query(f"""WITH c AS (SELECT doc_id, replace(replace(coalesce(text, ''), ' ', '/'), 'e', '.') AS p FROM documents)
SELECT doc_id, octet_length(encode(p)) BETWEEN 1 AND 4096 AND NOT contains(p, chr(92)) AND NOT {_BAD} AND NOT contains(split_part(p, '/', 1), ':') AS ok FROM c""")
def path_validity(spark, sf_dir):
    p = F.translate(F.coalesce("text", F.lit("")), " e", "/.")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", paths.is_valid(p).alias("ok"))


@query("""WITH e AS (SELECT event_id, 'a/' || CASE WHEN event_id % 3 = 0 THEN 'b/' ELSE '' END || 'l' AS path, repeat('../', (event_id % 5)::INT) || CASE WHEN event_id % 7 = 0 THEN 'x/../../' ELSE '' END || 'y' AS target FROM events),
w AS (SELECT event_id, 1 + (event_id % 3 = 0)::INT AS d, event_id % 5 AS ups, event_id % 7 = 0 AS more FROM e)
SELECT event_id, ups <= d AND (NOT more OR ups + 1 <= d) AS safe FROM w""")
def link_safety(spark, sf_dir):
    path = F.concat(F.lit("a/"), F.when(F.col("event_id") % 3 == 0, "b/").otherwise(""), F.lit("l"))
    target = F.concat(F.repeat(F.lit("../"), (F.col("event_id") % 5).cast("int")), F.when(F.col("event_id") % 7 == 0, "x/../../").otherwise(""), F.lit("y"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", paths.link_is_safe(path, target).alias("safe"))


@query("""SELECT ext, class, count(*) AS files FROM (SELECT 'txt' AS ext, 0 AS class FROM documents UNION ALL SELECT 'html', 0 FROM pages UNION ALL SELECT 'md', 0 FROM conversations UNION ALL SELECT 'txt', 0 FROM benchmark) GROUP BY ext, class""")
def classify_files(spark, sf_dir):
    files = classified(views.corpus(spark, sf_dir))
    return files.groupBy(paths.extension(F.col("path")).alias("ext"), F.col("class").cast("int").alias("class")).agg(F.count("*").alias("files"))


_SYNTHETIC = [("src/arm", 1, 2), ("src/data.bin", 2, 0), ("src/deep/er/copy.txt", 0, 0), ("src/empty", 0, 0), ("src/pack", 2, 0), ("src/photo.jpg", 2, 0), ("src/prog32", 1, 1), ("src/prog64", 1, 4), ("src/short.bin", 0, 0), ("src/table.bin", 0, 0), ("src/text.txt", 0, 0), ("src/한글/파일.txt", 0, 0)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', {c}, {t})" for p, c, t in _SYNTHETIC) + ") v(path, class, transform)")
def classify_programs(spark, sf_dir):
    files = classified(views.synthetic(spark).where("type = 0"))
    return files.select("path", F.col("class").cast("int").alias("class"), F.col("transform").cast("int").alias("transform"))


@query("SELECT doc_id, CAST(0 AS INTEGER) AS rule_class, false AS magic, false AS program FROM documents")
def classify_rules(spark, sf_dir):
    files = _docs(spark, sf_dir)
    sample = F.substring("content", 1, 65_536)
    return files.select(F.col("file_id").alias("doc_id"), by_rules(F.col("path"), sample).alias("rule_class"), has_compressed_magic(sample).alias("magic"), exec_transform(sample).isNotNull().alias("program"))


@query("SELECT o_orderkey, format('{:,}', o_orderkey * 7919) AS grouped, round(o_custkey * 100.0 / nullif(o_orderkey, 0), 1) AS percent FROM orders")
def report_numbers(spark, sf_dir):
    """Numbers as reports show them."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", scalars.grouped(F.col("o_orderkey") * 7919).alias("grouped"), scalars.percent(F.col("o_custkey"), F.col("o_orderkey")).alias("percent"))


@query("SELECT event_id, coalesce(regexp_extract(props, '^.+\\.([^.]*)$', 1), '') AS ext FROM (SELECT event_id, 'a.' || event_type || '.' || CASE WHEN event_id % 2 = 0 THEN 'gz' ELSE 'txt' END AS props FROM events)")
def extension_projection(spark, sf_dir):
    name = F.concat(F.lit("x.d/a."), "event_type", F.lit("."), F.when(F.col("event_id") % 2 == 0, "GZ").otherwise("tXt"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", paths.extension(name).alias("ext"))


# Deduplication


@query("""WITH h AS (SELECT lang, sha256(encode(text)) AS h, octet_length(encode(text)) AS n, row_number() OVER (PARTITION BY sha256(encode(text)) ORDER BY doc_id) AS r FROM documents)
SELECT lang, count(*) AS files, count(*) FILTER (r = 1) AS first_files, CAST(sum(n) AS BIGINT) AS bytes, CAST(coalesce(sum(n) FILTER (r > 1), 0) AS BIGINT) AS saved FROM h GROUP BY lang""")
def whole_file_dedup(spark, sf_dir):
    files = _docs(spark, sf_dir).select("file_id", "size", F.sha2("content", 256).alias("chunk_hash"), F.element_at(F.split("path", "/"), 2).alias("lang"))
    first = dedup.first_occurrences(files, ["file_id"]).groupBy("lang").agg(F.count("*").alias("first_files"), F.sum("size").alias("kept"))
    every = files.groupBy("lang").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return every.join(first, "lang", "left").select("lang", "files", F.coalesce("first_files", F.lit(0)).alias("first_files"), "bytes", (F.col("bytes") - F.coalesce("kept", F.lit(0))).alias("saved"))


@query(f"WITH {_REFS} SELECT count(*) AS chunk_refs, CAST(sum(chunk_len) AS BIGINT) AS bytes, (SELECT count(*) FROM chunks) AS unique_chunks, (SELECT CAST(sum(chunk_len) AS BIGINT) FROM chunks) AS unique_bytes FROM refs")
def fixed_chunk_dedup(spark, sf_dir):
    each = _refs(spark, sf_dir).groupBy("chunk_hash").agg(F.count("*").alias("n"), F.sum("chunk_len").alias("bytes"), F.first("chunk_len").alias("one"))
    return each.agg(F.sum("n").alias("chunk_refs"), F.sum("bytes").alias("bytes"), F.count("*").alias("unique_chunks"), F.sum("one").alias("unique_bytes"))


@query(f"WITH {_REFS} SELECT chunk_id, chunk_len, chunk_hash FROM chunks")
def first_chunk_ids(spark, sf_dir):
    chunks, _ = dedup.with_ids(written(_refs(spark, sf_dir), "refs"), ["file_id", "ref_pos"])
    return chunks.select("chunk_id", "chunk_len", "chunk_hash")


_LAGS = " + ".join(f"coalesce(lag(g, {k}) OVER w, 0) * {2**k}" for k in range(1, 16))
_CUTS = f"""b AS (SELECT doc_id, unnest(range(1, octet_length(encode(text)) + 1)) AS t, hex(encode(text)) AS hx FROM documents),
g AS (SELECT doc_id, t, ((('0x' || substr(hx, 2 * t - 1, 2))::BIGINT + 1) * 40503) % 65536 AS g FROM b),
r AS (SELECT doc_id, t, (g + {_LAGS}) % 65536 AS h FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY t)),
c AS (SELECT doc_id, list(t ORDER BY t) AS ps FROM r WHERE t >= 16 AND h < {1 << (16 - CDC["bits"])} GROUP BY doc_id),
d AS MATERIALIZED (SELECT doc_id, lang, octet_length(encode(text)) AS n, coalesce(ps, []) AS ps FROM documents LEFT JOIN c USING (doc_id)),
k AS (
  SELECT doc_id, lang, n, ps, 0::BIGINT AS s, least(coalesce(list_filter(ps, lambda x: x >= {CDC["least"]})[1], n), {CDC["most"]}, n)::BIGINT AS e, 0 AS ref_pos FROM d WHERE n > 0
  UNION ALL
  SELECT doc_id, lang, n, ps, e, least(coalesce(list_filter(ps, lambda x: x >= e + {CDC["least"]})[1], n), e + {CDC["most"]}, n)::BIGINT, ref_pos + 1 FROM k WHERE e < n)"""


@query(f"WITH RECURSIVE {_CUTS} SELECT doc_id, CAST(ref_pos AS INTEGER) AS ref_pos, s AS offs, e - s AS chunk_len FROM k")
def cdc_chunks(spark, sf_dir):
    cut = chunked(_docs(spark, sf_dir).withColumnRenamed("file_id", "doc_id"), key="doc_id", **CDC)
    return cut.select("doc_id", "ref_pos", F.col("offset").alias("offs"), "chunk_len")


@query(f"""WITH RECURSIVE {_CUTS}, p AS (SELECT k.doc_id, k.lang, ref_pos, e - s AS n, substr(hex(encode(text)), 2 * s + 1, 2 * (e - s)) AS part FROM k JOIN documents USING (doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id, ref_pos) AS r FROM p)
SELECT lang, CAST(sum(n) AS BIGINT) AS bytes, CAST(coalesce(sum(n) FILTER (r = 1), 0) AS BIGINT) AS unique_bytes, CAST(coalesce(sum(n) FILTER (r > 1), 0) AS BIGINT) AS saved FROM f GROUP BY lang""")
def cdc_dedup_savings(spark, sf_dir):
    files = _docs(spark, sf_dir)
    refs = chunked(files, **CDC).join(files.select("file_id", F.element_at(F.split("path", "/"), 2).alias("lang")), "file_id")
    refs = written(refs.select("file_id", "ref_pos", "chunk_len", "chunk_hash", "lang"), "cdc")
    kept = dedup.first_occurrences(refs, ["file_id", "ref_pos"]).groupBy("lang").agg(F.sum("chunk_len").alias("unique_bytes"))
    every = refs.groupBy("lang").agg(F.sum("chunk_len").alias("bytes")).join(kept, "lang", "left")
    unique = F.coalesce("unique_bytes", F.lit(0))
    return every.select("lang", "bytes", unique.alias("unique_bytes"), (F.col("bytes") - unique).alias("saved"))


@query(f"WITH {_REFS}, n AS (SELECT chunk_hash, count(*) AS uses, any_value(chunk_len) AS chunk_len FROM refs GROUP BY chunk_hash) SELECT chunk_hash, uses, (uses - 1) * chunk_len AS saved FROM n WHERE uses > 1 ORDER BY saved DESC, chunk_hash LIMIT 20")
def top_repeated_chunks(spark, sf_dir):
    n = _refs(spark, sf_dir).groupBy("chunk_hash").agg(F.count("*").alias("uses"), F.first("chunk_len").alias("chunk_len")).where("uses > 1")
    return n.select("chunk_hash", "uses", ((F.col("uses") - 1) * F.col("chunk_len")).alias("saved")).orderBy(F.desc("saved"), "chunk_hash").limit(20)


# Blocks and index


@query(f"WITH RECURSIVE {_PACKED} SELECT chunk_id, chunk_len, block_id FROM packed")
def pack_blocks(spark, sf_dir):
    return _tables(spark, sf_dir)[0].select("chunk_id", "chunk_len", "block_id")


@query(f"WITH RECURSIVE {_PACKED} SELECT chunk_id, block_id, CAST(coalesce(sum(chunk_len) OVER (PARTITION BY block_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_offset FROM packed")
def chunk_offsets(spark, sf_dir):
    return bl.chunk_offsets(_tables(spark, sf_dir)[0]).select("chunk_id", "block_id", "block_offset")


@query(f"WITH {_FILES} SELECT file_id AS block_id, CAST(32 + coalesce(sum(size + 16) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_offset FROM files")
def block_offsets(spark, sf_dir):
    return bl.block_offsets(_docs(spark, sf_dir).select(F.col("file_id").alias("block_id"), F.col("size").alias("stored_len"))).select("block_id", "file_offset")


@query("SELECT CASE o_orderkey % 4 WHEN 0 THEN 'store' WHEN 1 THEN 'zstd' WHEN 2 THEN 'lzma2' ELSE 'context' END AS codec_name, count(*) AS blocks, CAST(sum(o_custkey) AS BIGINT) AS raw_bytes, CAST(sum(o_custkey // 2) AS BIGINT) AS stored_bytes FROM orders GROUP BY 1")
def codec_rollup(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rollup.codec_rollup(o.select((F.col("o_orderkey") % 4).alias("codec"), F.col("o_custkey").alias("raw_len"), F.floor(F.col("o_custkey") / 2).alias("stored_len")))


@query("SELECT l_linenumber % 5 AS transform, count(*) AS files FROM lineitem GROUP BY 1")
def transform_hist(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rollup.transform_histogram(items.select(F.lit(0).alias("type"), (F.col("l_linenumber") % 5).alias("transform")))


@query(f"""WITH RECURSIVE {_PACKED} SELECT (SELECT count(*) FROM documents) AS files, 0::BIGINT AS dirs, 0::BIGINT AS symlinks, (SELECT CAST(sum(chunk_len) AS BIGINT) FROM refs) AS input_bytes, (SELECT count(*) FROM refs) AS chunk_refs,
(SELECT CAST(sum(chunk_len) AS BIGINT) FROM packed) AS unique_bytes, (SELECT count(*) FROM packed) AS unique_chunks, (SELECT count(DISTINCT block_id) FROM packed) AS blocks, (SELECT CAST(sum(chunk_len) AS BIGINT) FROM refs) - (SELECT CAST(sum(chunk_len) AS BIGINT) FROM packed) AS saved_bytes""")
def create_stats(spark, sf_dir):
    chunks, refs = _tables(spark, sf_dir)
    return rollup.create_stats(_docs(spark, sf_dir), refs, chunks, chunks.select("block_id").distinct())


@query(f"WITH {_REFS} SELECT f.path, CAST(coalesce(sum(chunk_len), 0) AS BIGINT) AS size FROM files f LEFT JOIN refs r ON f.path = r.path GROUP BY f.path")
def file_sizes(spark, sf_dir):
    return rollup.file_sizes(_docs(spark, sf_dir), _refs(spark, sf_dir))


@query("""WITH f AS (SELECT 0 AS class, 'txt' AS ext, octet_length(encode(text)) AS size FROM documents UNION ALL SELECT 0, 'html', octet_length(encode(html)) FROM pages)
SELECT CAST(CASE WHEN grouping(class) = 1 THEN -1 ELSE class END AS INTEGER) AS class, CASE WHEN grouping(ext) = 1 THEN '*' ELSE ext END AS ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY ROLLUP (class, ext)""")
def size_report(spark, sf_dir):
    files = classified(views.documents(spark, sf_dir).unionByName(views.pages(spark, sf_dir)))
    return rollup.size_report(files.select(F.col("class").cast("int").alias("class"), paths.extension(F.col("path")).alias("ext"), "size"))


# Encodings

@query(f"""WITH {_FILES}, s AS (SELECT path, hex(encode(path)) AS b, coalesce(hex(encode(lag(path) OVER (ORDER BY path))), '') AS a FROM files),
m AS (SELECT path, b, CAST(list_max([0] || [CASE WHEN a[1:2 * i] = b[1:2 * i] THEN i ELSE 0 END FOR i IN range(1, least(length(a), length(b)) // 2 + 1)]) AS INTEGER) AS shared FROM s)
SELECT path, shared, lower(substr(b, 2 * shared + 1)) AS suffix_hex FROM m""")
def path_front_coding(spark, sf_dir):
    return encodings.front_coded(_docs(spark, sf_dir))


@query(f"WITH {_FILES} SELECT row_number() OVER (ORDER BY path) - 1 AS pos, path FROM files")
def path_front_decoding(spark, sf_dir):
    """Paths again, from nothing but shared lengths and suffixes in order."""
    coded = numbered(written(encodings.front_coded(_docs(spark, sf_dir)), "front"), ["path"], "pos").select("pos", "shared", "suffix_hex")
    return encodings.front_decoded(written(coded, "front-coded"), ["pos"]).select("pos", "path")


@query(f"WITH {_FILES} SELECT path, mtime_s FROM files")
def mtime_decoding(spark, sf_dir):
    coded = written(encodings.mtime_deltas(_docs(spark, sf_dir)).select("path", "delta"), "mtime-coded")
    return encodings.mtimes_decoded(coded, ["path"]).select("path", "mtime_s")


@query(f"WITH {_REFS} SELECT path, ref_pos, chunk_id FROM refs JOIN chunks USING (chunk_hash)")
def ref_decoding(spark, sf_dir):
    _, refs = dedup.with_ids(written(_refs(spark, sf_dir), "refs"), ["file_id", "ref_pos"])
    coded = written(encodings.ref_deltas(refs).select("path", "ref_pos", "delta"), "ref-coded")
    return encodings.refs_decoded(coded, ["path", "ref_pos"]).select("path", "ref_pos", "chunk_id")


@query(f"WITH {_FILES} SELECT path, mtime_s - coalesce(lag(mtime_s) OVER (ORDER BY path), 0) AS delta FROM files")
def mtime_delta(spark, sf_dir):
    return encodings.mtime_deltas(_docs(spark, sf_dir)).select("path", "delta")


@query(f"WITH {_REFS} SELECT path, ref_pos, chunk_id, chunk_id - (coalesce(lag(chunk_id) OVER (ORDER BY path, ref_pos), -1) + 1) AS delta FROM refs JOIN chunks USING (chunk_hash)")
def ref_delta(spark, sf_dir):
    _, refs = dedup.with_ids(written(_refs(spark, sf_dir), "refs"), ["file_id", "ref_pos"])
    return encodings.ref_deltas(refs)


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * event_id * 97 ELSE -event_id * 12345 END AS v FROM events), u AS (SELECT event_id, v, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS u FROM v)
SELECT event_id, u AS zigzag, CAST(CASE WHEN u < 128 THEN 1 WHEN u < 16384 THEN 2 WHEN u < 2097152 THEN 3 WHEN u < 268435456 THEN 4 WHEN u < 34359738368 THEN 5 WHEN u < 4398046511104 THEN 6 ELSE 7 END AS INTEGER) AS bytes, v AS back FROM u""")
def varint_len(spark, sf_dir):
    e = F.col("event_id")
    v = F.when(e % 2 == 0, e * e * 97).otherwise(-e * 12345)
    u = scalars.zigzag(v)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", u.alias("zigzag"), scalars.varint_length(u).alias("bytes"), scalars.unzigzag(u).alias("back"))


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'store' WHEN 1 THEN 'zstd' WHEN 2 THEN 'lzma2' WHEN 3 THEN 'context' WHEN 4 THEN 'context-fast' WHEN 5 THEN 'zstd-primed' ELSE 'unknown-6' END AS codec_name,
CAST(least(greatest(CASE WHEN o_orderkey <= 1 THEN 0 ELSE length(bin(o_orderkey - 1)) END + 1, 16), 24) AS INTEGER) AS table_bits, o_orderkey % 65536 AS parsed, CAST(floor((o_orderkey - 500) / 2.0::DOUBLE) AS BIGINT) AS mtime_s FROM orders""")
def scalar_functions(spark, sf_dir):
    k = F.col("o_orderkey")
    ns = (k - 500) * 500_000_000
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", scalars.codec_name(k % 7).alias("codec_name"), scalars.table_bits(k).cast("int").alias("table_bits"), scalars.parse_hex(F.concat(F.lit("0x"), F.hex(k % 65536))).alias("parsed"), scalars.mtime_parts(ns)["mtime_s"].alias("mtime_s")
    )


# Reading


@query(f"""WITH RECURSIVE {_PACKED}, a AS (SELECT path, ref_pos, block_id, lag(block_id) OVER (PARTITION BY path ORDER BY ref_pos) AS before FROM refs JOIN packed USING (chunk_hash))
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY ref_pos) - 1 AS INTEGER) AS step, block_id FROM a WHERE before IS DISTINCT FROM block_id""")
def access_sequence(spark, sf_dir):
    chunks, refs = _tables(spark, sf_dir)
    return encodings.access_sequence(refs.select("path", "ref_pos", "chunk_id").join(chunks.select("chunk_id", "block_id"), "chunk_id"))


@query(f"WITH RECURSIVE {_PACKED} SELECT DISTINCT block_id FROM refs JOIN packed USING (chunk_hash) WHERE starts_with(path, 'documents/de/')")
def blocks_needed(spark, sf_dir):
    chunks, refs = _tables(spark, sf_dir)
    return needed_blocks(chunks.select("block_id").distinct(), chunks, refs.where(F.startswith("path", F.lit("documents/de/"))))


@query(f"WITH {_FILES} SELECT path, sha256(content) AS hash FROM files")
def reassemble_hash(spark, sf_dir):
    files = _docs(spark, sf_dir)
    parts = chunked(files, with_data=True, **CDC).withColumn("part", F.floor(F.col("ref_pos") / 256))
    some = parts.groupBy("file_id", "part").agg(F.collect_list(F.struct("ref_pos", "data")).alias("d")).select("file_id", "part", joined(F.transform(F.array_sort("d"), lambda x: x["data"])).alias("data"))
    whole = some.groupBy("file_id").agg(F.collect_list(F.struct("part", "data")).alias("d")).select("file_id", F.sha2(joined(F.transform(F.array_sort("d"), lambda x: x["data"])), 256).alias("hash"))
    return files.select("file_id", "path").join(whole, "file_id", "left").select("path", F.coalesce("hash", F.sha2(F.lit(b""), 256)).alias("hash"))


# Integrity


@query(f"""WITH RECURSIVE {_PACKED}, s AS (SELECT block_id, CAST(sum(chunk_len) AS BIGINT) AS total FROM packed GROUP BY block_id)
SELECT block_id, total + CASE WHEN block_id % 5 = 2 THEN 1 ELSE 0 END AS raw_len, total FROM s WHERE block_id % 5 = 2""")
def verify_sums(spark, sf_dir):
    chunks, _ = _tables(spark, sf_dir)
    blocks = chunks.groupBy("block_id").agg(F.sum("chunk_len").alias("raw_len")).withColumn("raw_len", F.col("raw_len") + (F.col("block_id") % 5 == 2).cast("long"))
    return verify.bad_block_sums(blocks, chunks)


@query(f"WITH {_REFS} SELECT path, ref_pos, chunk_id FROM refs JOIN chunks USING (chunk_hash) WHERE chunk_id % 10 = 3")
def verify_refs(spark, sf_dir):
    chunks, refs = dedup.with_ids(written(_refs(spark, sf_dir), "refs"), ["file_id", "ref_pos"])
    return verify.dangling_refs(refs, chunks.where("chunk_id % 10 <> 3")).select("path", "ref_pos", "chunk_id")


@query(f"WITH {_REFS}, l AS (SELECT DISTINCT chunk_hash FROM refs WHERE file_id % 2 = 0) SELECT chunk_id FROM chunks WHERE chunk_hash NOT IN (SELECT chunk_hash FROM l)")
def orphan_chunks(spark, sf_dir):
    chunks, refs = dedup.with_ids(written(_refs(spark, sf_dir), "refs"), ["file_id", "ref_pos"])
    return verify.orphan_chunks(chunks, refs.where("file_id % 2 = 0")).select("chunk_id")


@query(f"""WITH {_FILES}, a AS (SELECT DISTINCT unnest(['documents', 'documents/' || lang, 'documents/' || lang || '/' || split_part(path, '/', 3)]) AS path FROM files) SELECT path FROM a""")
def missing_parents(spark, sf_dir):
    return trees.missing_parents(_docs(spark, sf_dir))


@query(f"WITH {_FILES} SELECT path, 'documents/' || lang || '/' || split_part(path, '/', 3) AS inside FROM files WHERE split_part(path, '/', 3) IN ('src3', 'src7')")
def nesting_violations(spark, sf_dir):
    files = _docs(spark, sf_dir).select("path", "type")
    odd = files.select(F.concat_ws("/", F.slice(F.split("path", "/"), 1, 3)).alias("path")).distinct().where("path LIKE '%/src3' OR path LIKE '%/src7'").withColumn("type", F.lit(2).cast("short"))
    return trees.nesting_violations(files.unionByName(odd))


@query(f"""WITH {_FILES} SELECT path, CASE file_id % 9 WHEN 0 THEN 'only_left' WHEN 1 THEN 'only_right' ELSE 'changed' END AS status FROM files WHERE file_id % 9 IN (0, 1, 2)""")
def tree_diff(spark, sf_dir):
    tree = _docs(spark, sf_dir).select("file_id", "path", "type", F.sha2("content", 256).alias("hash"))
    right = tree.where("file_id % 9 <> 0").withColumn("hash", F.when(F.col("file_id") % 9 == 2, F.reverse("hash")).otherwise(F.col("hash")))
    return trees.tree_diff(tree.where("file_id % 9 <> 1"), right)


@query("""SELECT doc_id AS block_id FROM documents WHERE doc_id % 50 = 7 AND octet_length(encode(text)) > 0""")
def verify_block_hashes(spark, sf_dir):
    blocks = _docs(spark, sf_dir).select(F.col("file_id").alias("block_id"), F.col("content").alias("payload"), F.sha2("content", 256).alias("hash"))
    broken = F.when((F.col("block_id") % 50 == 7) & (F.octet_length("payload") > 0), F.overlay(F.col("payload"), F.lit(b"\x00"), F.lit(1), F.lit(1))).otherwise(F.col("payload"))
    return verify.bad_block_hashes(blocks.withColumn("payload", broken))


@query(f"""WITH {_FILES} SELECT path, CASE file_id % 100 WHEN 1 THEN 'type' WHEN 2 THEN 'transform' WHEN 3 THEN 'mtime_ns' ELSE 'link_target' END AS problem FROM files WHERE file_id % 100 IN (1, 2, 3, 4)""")
def verify_entries(spark, sf_dir):
    k = F.col("file_id") % 100
    files = _docs(spark, sf_dir).withColumns({"type": F.when(k == 1, 3).when(k == 4, 2).otherwise(0), "transform": F.when(k == 2, 5).otherwise(0), "mtime_ns": F.when(k == 3, 1_000_000_000).otherwise(F.col("mtime_ns"))})
    return verify.bad_entries(files)


@query(f"WITH {_FILES}, o AS (SELECT file_id, path, lag(path) OVER (ORDER BY file_id) AS before FROM files) SELECT path FROM o WHERE before IS NOT NULL AND NOT before < path")
def verify_order(spark, sf_dir):
    return verify.unsorted_paths(_docs(spark, sf_dir), "file_id")


# Codecs, transforms, archives


@query("""SELECT doc_id, sha256(encode(coalesce(text, ''))) AS hash, CASE WHEN octet_length(encode(text)) >= 1000 THEN true END AS packed FROM documents""")
def codec_roundtrip(spark, sf_dir):
    """Digests of what comes back of zstd or LZMA2, and whether texts of 1000 bytes and more got smaller."""
    files = _docs(spark, sf_dir).where("size > 0")
    packed = files.select(F.col("file_id").alias("doc_id"), "size", codecs.compressed(F.col("content"), 3, (codecs.ZSTD, codecs.LZMA2)).alias("c"))
    back = codecs.decompressed(F.col("c.codec"), F.col("c.payload"), F.col("size"))
    smaller = (F.col("c.codec") != codecs.STORE) & (F.octet_length("c.payload") < F.col("size"))
    done = packed.select("doc_id", F.sha2(back, 256).alias("hash"), F.when(F.col("size") >= 1000, smaller).alias("packed"))
    empty = _docs(spark, sf_dir).where("size = 0").select(F.col("file_id").alias("doc_id"), F.sha2("content", 256).alias("hash"), F.lit(None).cast("boolean").alias("packed"))
    return done.unionByName(empty)


_BINARY = " || ".join(f"sha256(coalesce(text, '') || '{i}')" for i in range(16))


@query(f"SELECT doc_id, doc_id % 5 AS transform, sha256(unhex({_BINARY})) AS hash FROM documents")
def transform_roundtrip(spark, sf_dir):
    """Digests of what comes back, of 512 bytes made of each text's digests, in which all bytes that transforms look for occur."""
    data = F.unhex(F.concat(*[F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit(str(i))), 256) for i in range(16)]))
    t = (F.col("doc_id") % 5).cast("short")
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", t.alias("transform"), data.alias("content"))
    done = files.withColumn("t", transforms.transformed(F.col("transform"), F.col("content")))
    return done.select("doc_id", F.col("transform").cast("long").alias("transform"), F.sha2(transforms.restored(F.col("t.transform"), F.col("t.data")), 256).alias("hash"))


def _context_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, docs and content of 32 documents in a row each, with each context codec's own result."""
    docs = _docs(spark, sf_dir).select((F.floor(F.col("file_id") / 32)).alias("block"), "file_id", "content")
    packed = docs.groupBy("block").agg(F.count("*").alias("docs"), F.array_sort(F.collect_list(F.struct("file_id", "content"))).alias("d"))
    packed = packed.select("block", "docs", joined(F.transform("d", lambda x: x["content"])).alias("content"))
    coded = {name: codecs.compressed(F.col("content"), 10, (codec,)) for name, codec in (("fast", codecs.CONTEXT_FAST), ("full", codecs.CONTEXT), ("zstd", codecs.ZSTD))}
    return written(packed.repartition("block").withColumns(coded), "context")


@query("""SELECT doc_id // 32 AS block, count(*) AS docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS raw_bytes, sha256(string_agg(text, '' ORDER BY doc_id)) AS fast_sha256,
sha256(string_agg(text, '' ORDER BY doc_id)) AS full_sha256, true AS beats_zstd FROM documents GROUP BY doc_id // 32""")
def context_roundtrip(spark, sf_dir):
    """Digests of what both codecs give back, and whether both payloads are smaller than zstd's at level 19."""
    size = F.octet_length("content").cast("long")
    back = [F.sha2(codecs.decompressed(F.col(f"{c}.codec"), F.col(f"{c}.payload"), size), 256).alias(f"{c}_sha256") for c in ("fast", "full")]
    stored = {c: F.octet_length(f"{c}.payload") for c in ("fast", "full", "zstd")}
    return _context_coded(spark, sf_dir).select("block", "docs", size.alias("raw_bytes"), *back, (F.greatest(stored["fast"], stored["full"]) < stored["zstd"]).alias("beats_zstd"))


_SMALL = {"least": 1024, "bits": 11, "most": 16_384, "block_size": 1 << 20, "level": 3}


@query(f"WITH {_FILES} SELECT path, sha256(content) AS hash FROM files")
def archive_roundtrip(spark, sf_dir):
    path = f"{shared_dir(spark)}/stratarc-archive-{uuid.uuid4().hex[:12]}"
    archive.create(_docs(spark, sf_dir), path, archive.Options(**_SMALL))
    opened = archive.Archive(spark, path)
    return opened.read(opened.entries).select("path", "hash")


@query("SELECT CAST(NULL AS VARCHAR) AS problem, CAST(NULL AS VARCHAR) AS subject WHERE false")
def archive_verify(spark, sf_dir):
    path = f"{shared_dir(spark)}/stratarc-archive-{uuid.uuid4().hex[:12]}"
    archive.create(views.with_parents(_docs(spark, sf_dir)), path, archive.Options(**_SMALL, password="correct horse"))
    return archive.Archive(spark, path, "correct horse").verify()


@query(f"WITH {_FILES} SELECT path FROM files WHERE file_id % 50 = 0")
def archive_damage(spark, sf_dir):
    """Files of which nothing is handed out: their content doesn't give the hash that the (here falsified) index has."""
    path = f"{shared_dir(spark)}/stratarc-archive-{uuid.uuid4().hex[:12]}"
    archive.create(_docs(spark, sf_dir), path, archive.Options(**_SMALL))
    opened = archive.Archive(spark, path)
    number = F.regexp_extract("path", "([0-9]+)[.]txt$", 1).cast("long")
    opened.parts["entries"] = opened.entries.withColumn("hash", F.when(number % 50 == 0, F.sha2("path", 256)).otherwise(F.col("hash")))
    return opened.read(opened.entries).where("content IS NULL").select("path")


@query(f"""WITH {_FILES}, p AS (SELECT DISTINCT unnest(['documents', 'documents/' || lang, 'documents/' || lang || '/' || source]) AS d FROM documents)
SELECT count(*) AS files, (SELECT count(*) FROM p) AS dirs, 0::BIGINT AS symlinks, CAST(sum(size) AS BIGINT) AS logical_bytes, true AS every_byte_in_a_block, true AS smaller FROM files""")
def archive_info(spark, sf_dir):
    """The counts of an archive's info; unique bytes are those of all blocks, and stored bytes are fewer."""
    path = f"{shared_dir(spark)}/stratarc-archive-{uuid.uuid4().hex[:12]}"
    archive.create(views.with_parents(_docs(spark, sf_dir)), path, archive.Options(**_SMALL, password="correct horse"))
    i = archive.Archive(spark, path, "correct horse").info()
    raw = sum(c["raw_bytes"] for c in i["codecs"].values())
    row = (i["files"], i["dirs"], i["symlinks"], i["logical_bytes"], raw == i["unique_bytes"] <= i["logical_bytes"], i["stored_bytes"] < raw)
    return spark.createDataFrame([row], "files long, dirs long, symlinks long, logical_bytes long, every_byte_in_a_block boolean, smaller boolean")


@query("SELECT event_type, user_id, max_by(value, event_id) AS value, CAST(rank() OVER (PARTITION BY event_type ORDER BY max_by(value, event_id)) = 1 AS BOOLEAN) AS best FROM events GROUP BY event_type, user_id")
def latest_and_best(spark, sf_dir):
    """Later results replace earlier ones of the same key; the smallest of each group is marked."""
    from pyspark.sql import Window

    last = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type", "user_id").agg(F.max_by("value", "event_id").alias("value"))
    return last.withColumn("best", F.rank().over(Window.partitionBy("event_type").orderBy("value")) == 1)


# Streaming


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # a pattern, since a stream's plain path has to be a folder and the table may be one file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/documents.parque[t]")


@query("SELECT DISTINCT sha256(encode(text)) AS chunk_hash FROM documents")
def stream_dedup(spark, sf_dir):
    from stratarc.streaming import ingest

    hashes = _stream(spark, sf_dir).select(F.sha2(F.encode("text", "UTF-8"), 256).alias("chunk_hash"))
    return ingest.run_available(ingest.stream_dedup(hashes), "dedup").select("chunk_hash")


@query(f"""WITH RECURSIVE c AS (SELECT doc_id AS seq, CAST(octet_length(encode(text)) AS BIGINT) AS chunk_len, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
f AS (SELECT seq, chunk_len, r, chunk_len AS used, 0::BIGINT AS block_id FROM c WHERE r = 1 UNION ALL
SELECT c.seq, c.chunk_len, c.r, CASE WHEN used > 0 AND used + c.chunk_len > {BLOCK} THEN c.chunk_len ELSE used + c.chunk_len END, block_id + CASE WHEN used > 0 AND used + c.chunk_len > {BLOCK} THEN 1 ELSE 0 END FROM f JOIN c ON c.r = f.r + 1)
SELECT seq, chunk_len, block_id FROM f""")
def stream_pack(spark, sf_dir):
    from stratarc.streaming import ingest

    rows = _stream(spark, sf_dir).select(F.col("doc_id").alias("seq"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("chunk_len"))
    return ingest.stream_pack(rows, BLOCK).select("seq", "chunk_len", "block_id")
