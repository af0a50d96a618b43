"""Queries of scans, chunks and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest as I
from ..sources.catalog import Roles
from .registry import CHUNKS, FILES, query

MOST = 20_000


@query(f"WITH {FILES} SELECT path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS content_hash FROM files WHERE strlen(text) <= {MOST}")
def scan_files(spark, sf_dir):
    return I.scan(Roles(spark, sf_dir).files(), MOST)


@query(f"""WITH {FILES}, l AS (SELECT path, string_split(text, chr(10)) AS lines, len(string_split(text, chr(10))) AS n FROM files),
w AS (SELECT path, lines, n, unnest(range(0, CAST(CASE WHEN n <= 5 THEN 0 ELSE ceil((n - 5) / 4.0) * 4 END AS BIGINT) + 1, 4)) AS pos FROM l)
SELECT path, CAST(pos / 4 AS INTEGER) AS ordinal, CAST(pos + 1 AS INTEGER) AS start_line, CAST(least(pos + 5, n) AS INTEGER) AS end_line,
CAST(CASE WHEN pos = 0 THEN 0 ELSE strlen(array_to_string(lines[1:pos], chr(10))) + 1 END AS BIGINT) AS start_byte,
CAST(CASE WHEN pos = 0 THEN 0 ELSE strlen(array_to_string(lines[1:pos], chr(10))) + 1 END + strlen(array_to_string(lines[pos+1:pos+5], chr(10))) AS BIGINT) AS end_byte,
sha256(array_to_string(lines[pos+1:pos+5], chr(10))) AS chunk_hash FROM w""")
def chunk_documents(spark, sf_dir):
    rows = I.chunk_lines(Roles(spark, sf_dir).files(), 5, 0.2)
    return rows.select("path", "ordinal", "start_line", "end_line", "start_byte", "end_byte", F.sha2("text", 256).alias("chunk_hash"))


@query(f"WITH {FILES} SELECT path, sha256(text) AS content_hash FROM files WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0")
def existing_hashes(spark, sf_dir):
    h = F.unhex(F.sha2("text", 256))
    files = Roles(spark, sf_dir).files().select("path", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 11 == 0, F.substring(h, 1, 8)).otherwise(h).alias("content_hash"))
    return I.existing_hashes(files).select("path", F.lower(F.hex("content_hash")).alias("content_hash"))


@query(f"""WITH {FILES}, k AS (SELECT path, sha256(text || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) AS h FROM files WHERE doc_id % 5 <> 0), f AS (SELECT path, sha256(text) AS h FROM files WHERE doc_id % 3 <> 0)
SELECT COALESCE(k.path, f.path) AS path, CASE WHEN k.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'deleted' WHEN k.h = f.h THEN 'unchanged' ELSE 'changed' END AS status FROM k FULL JOIN f ON k.path = f.path""")
def change_detection(spark, sf_dir):
    files = Roles(spark, sf_dir).files()
    known = files.where("doc_id % 5 <> 0").select("path", F.sha2(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "x").otherwise("")), 256).alias("content_hash"))
    return I.changes(known, files.where("doc_id % 3 <> 0").select("path", F.sha2("text", 256).alias("content_hash")))


@query(f"WITH {FILES} SELECT DISTINCT path FROM files")
def list_files(spark, sf_dir):
    return Roles(spark, sf_dir).files().select("path").distinct()


@query(f"WITH {CHUNKS}, ids AS (SELECT kind, chunk_hash, MIN(id) AS found_id FROM chunks WHERE ordinal % 2 = 0 GROUP BY 1, 2) SELECT c.id, c.kind, i.found_id FROM chunks c LEFT JOIN ids i ON c.kind = i.kind AND c.chunk_hash = i.chunk_hash")
def find_chunk_id(spark, sf_dir):
    chunks = Roles(spark, sf_dir).chunks()
    return I.find_chunk_ids(chunks.where("ordinal % 2 = 0"), chunks.select("id", "kind", "chunk_hash")).select("id", "kind", "found_id")


@query(f"""WITH {FILES}, k AS (SELECT path, sha256(text) AS h, CAST(strlen(text) AS BIGINT) AS s, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE language END AS l FROM files WHERE doc_id % 4 <> 0),
f AS (SELECT path, sha256(text || CASE WHEN doc_id % 6 = 0 THEN 'x' ELSE '' END) AS h, CAST(strlen(text) AS BIGINT) AS s, language AS l FROM files WHERE doc_id % 3 <> 1)
SELECT COALESCE(k.path, f.path) AS path, COALESCE(f.h, k.h) AS content_hash, COALESCE(f.s, k.s) AS size, CASE WHEN f.path IS NOT NULL THEN f.l ELSE k.l END AS primary_language, f.path IS NOT NULL AND (k.path IS NULL OR k.h <> f.h OR COALESCE(k.l, '') <> COALESCE(f.l, '')) AS updated FROM k FULL JOIN f ON k.path = f.path""")
def upsert_files(spark, sf_dir):
    files = Roles(spark, sf_dir).files()
    row = lambda f, h, l: f.select("path", F.sha2(h, 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size"), l.alias("primary_language"))
    known = row(files.where("doc_id % 4 <> 0"), F.col("text"), F.when(F.col("doc_id") % 9 != 0, F.col("language")))
    found = row(files.where("doc_id % 3 <> 1"), F.concat("text", F.when(F.col("doc_id") % 6 == 0, "x").otherwise("")), F.col("language"))
    return I.upsert_files(known, found)


@query(f"WITH {CHUNKS} SELECT id, path, CASE WHEN ordinal % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM chunks WHERE ordinal % 3 = 0 OR ordinal % 2 = 0")
def upsert_chunks(spark, sf_dir):
    c = Roles(spark, sf_dir).chunks()
    state = lambda where, s: c.where(where).select("id", "path", F.lit(s).alias("state"))
    return I.upsert_latest(state("ordinal % 2 = 0", "old"), state("ordinal % 3 = 0", "new"))


@query(f"WITH {CHUNKS}, h AS (SELECT kind, left(chunk_hash, 2) AS k, MIN(id) AS reused_from, COUNT(*) AS n FROM chunks WHERE ordinal % 2 = 0 GROUP BY 1, 2) SELECT c.id, h.reused_from, CAST(split_part(h.reused_from, '-', 1) AS DOUBLE) AS first_value FROM chunks c LEFT JOIN h ON c.kind = h.kind AND left(c.chunk_hash, 2) = h.k WHERE ordinal % 2 = 1")
def reuse_embeddings(spark, sf_dir):
    c = Roles(spark, sf_dir).chunks().withColumn("chunk_hash", F.left("chunk_hash", F.lit(2)))
    known = c.where("ordinal % 2 = 0").withColumn("embedding", F.array(F.split("id", "-")[0].cast("double")))
    return I.reuse_embeddings(c.where("ordinal % 2 = 1").select("id", "kind", "chunk_hash"), known.select("id", "kind", "chunk_hash", "embedding")).select("id", "reused_from", F.col("embedding")[0].alias("first_value"))


@query(f"WITH {CHUNKS} SELECT id, path, ordinal FROM chunks WHERE CAST(substr(path, 2) AS BIGINT) % 2 = 1 OR ordinal < 2")
def prune_missing_chunks(spark, sf_dir):
    c = Roles(spark, sf_dir).chunks().select("id", "path", "ordinal")
    files = c.where(F.substring("path", 2, 8).cast("long") % 2 == 0).select("path").distinct()
    return I.prune_chunks(c, files, c.where("ordinal < 2").select("id"))


SYMBOLS = "syms AS (SELECT DISTINCT path, 'definition' AS kind, start_byte, end_byte, unnest(list_distinct(regexp_extract_all(text, '(?:^|[\\s.])([A-Z][a-z]{3,})', 1))) AS name FROM chunks UNION ALL SELECT DISTINCT path, 'reference' AS kind, start_byte, end_byte, unnest(list_distinct(regexp_extract_all(text, '(?:^|\\s)(th[a-z]{2,6})', 1))) AS name FROM chunks)"
DEFINITION, REFERENCE = r"(?:^|[\s.])([A-Z][a-z]{3,})", r"(?:^|\s)(th[a-z]{2,6})"


def symbols(spark, sf_dir):
    return I.extract_symbols(Roles(spark, sf_dir).chunks(), DEFINITION, REFERENCE)


@query(f"WITH {CHUNKS}, {SYMBOLS} SELECT sha256(path || chr(31) || kind || chr(31) || start_byte || chr(31) || end_byte || chr(31) || name) AS id, path, name, kind, start_byte, end_byte FROM syms")
def extract_symbols(spark, sf_dir):
    return symbols(spark, sf_dir)


@query(f"WITH {CHUNKS}, {SYMBOLS} SELECT path, name, kind FROM syms WHERE path <> 'c00000003' UNION ALL SELECT 'c00000003', 'replaced', 'definition'")
def replace_file_graph(spark, sf_dir):
    s = symbols(spark, sf_dir).select("path", "name", "kind")
    one = spark.range(1).select(F.lit("c00000003").alias("path"))
    return I.replace_rows(s, one, one.select("path", F.lit("replaced").alias("name"), F.lit("definition").alias("kind")))


@query(f"WITH {CHUNKS}, {SYMBOLS} SELECT 'chunks' AS \"table\", COUNT(*) AS n FROM chunks WHERE path NOT IN ('c00000001', 'c00000002') UNION ALL SELECT 'files', COUNT(DISTINCT path) FROM chunks WHERE path NOT IN ('c00000001', 'c00000002') UNION ALL SELECT 'symbols', COUNT(*) FROM syms WHERE path NOT IN ('c00000001', 'c00000002')")
def delete_file_cascade(spark, sf_dir):
    c = Roles(spark, sf_dir).chunks()
    gone = spark.range(1, 3).select(F.format_string("c%08d", "id").alias("path"))
    tables = I.delete_files({"chunks": (c, ["path"]), "files": (c.select("path").distinct(), ["path"]), "symbols": (symbols(spark, sf_dir), ["path"])}, gone)
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("table"), "n") for k, t in sorted(tables.items())]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"WITH {CHUNKS} SELECT path, id, ordinal FROM chunks")
def chunk_ordinals(spark, sf_dir):
    return I.ordinals(Roles(spark, sf_dir).chunks().drop("ordinal").withColumn("start_byte", F.col("start_byte"))).select("path", "id", "ordinal")


@query("SELECT 'u' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 5 AS VARCHAR) AS path, COUNT(*) AS n_events FROM events GROUP BY user_id, event_id % 5 HAVING COUNT(*) FILTER (WHERE event_type = 'purchase') = 0")
def incomplete_files(spark, sf_dir):
    e = Roles(spark, sf_dir).read("events")
    return I.incomplete(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 5).cast("string")).alias("path"), F.when(F.col("event_type") == "purchase", "end").otherwise("content").alias("event_type")))


@query(f"WITH {FILES} SELECT path, sha256(path || chr(31) || 'definition' || chr(31) || 0 || chr(31) || strlen(text) || chr(31) || language) AS id FROM files")
def stable_ids(spark, sf_dir):
    return Roles(spark, sf_dir).files().select("path", I.stable_id(F.col("path"), F.lit("definition"), F.lit(0), F.octet_length("text"), F.col("language")).alias("id"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS BIGINT) AS n_tokens, sha256(array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ')) AS tokens_hash FROM documents")
def tokenize(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return Roles(spark, sf_dir).read("documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_hash"))




@query("""SELECT o_orderkey, array_to_string(list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([a-zA-Z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-zA-Z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''), ',') AS parts
FROM (SELECT o_orderkey, 'getHTTPServer' || CAST(o_orderkey AS VARCHAR) || 'Of_' || o_orderpriority || 'x2y' AS t FROM orders)""")
def split_identifier(spark, sf_dir):
    t = F.concat(F.lit("getHTTPServer"), F.col("o_orderkey").cast("string"), F.lit("Of_"), "o_orderpriority", F.lit("x2y"))
    return Roles(spark, sf_dir).read("orders").select("o_orderkey", F.array_join(T.identifier_parts(t), ",").alias("parts"))




@query("""WITH w AS (SELECT item_id, list_transform(regexp_extract_all(lower(text || ' v2x utf8'), '[\\p{L}\\p{N}]+'), lambda t: list_concat([t], list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(t, '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda p: p <> '' AND p <> t))) AS l FROM benchmark)
SELECT item_id, array_to_string(flatten(l), ' ') AS fts FROM w""")
def fts_text(spark, sf_dir):
    return Roles(spark, sf_dir).read("benchmark").select("item_id", T.search_text(F.concat("text", F.lit(" v2x utf8"))).alias("fts"))


@query("""WITH w AS (SELECT item_id, list_filter(flatten(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: list_concat([t], list_filter(string_split(regexp_replace(t, '[^a-z0-9]+', ' ', 'g'), ' '), lambda p: p <> '' AND p <> t)))), lambda t: strlen(t) >= 2) AS l FROM benchmark),
u AS (SELECT item_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM w), f AS (SELECT item_id, t, MIN(i) AS i FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM f)
SELECT item_id, string_agg(t, ' OR ' ORDER BY n) AS fts_query FROM r WHERE n <= 32 GROUP BY 1""")
def fts_query_terms(spark, sf_dir):
    return Roles(spark, sf_dir).read("benchmark").select("item_id", T.query_string(F.col("text")).alias("fts_query"))
