"""Queries of context assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import assembly as A
from ..operators import history as H
from ..operators import render as R
from ..operators import topology as T
from ..sources.catalog import Roles
from .history import _cochange_of
from .registry import CHUNKS, COCHANGE, COMMITS, DEPS, FILES, pagerank_sql, query

_HITS = "hits AS (SELECT id, CAST(CAST(substr(path, 2) AS BIGINT) % 10 AS DOUBLE) / 10 AS score FROM chunks WHERE ordinal % 2 = 1)"
_TIERS = f"""{CHUNKS}, {_HITS}, tiers AS (SELECT id, path, start_byte, start_line, end_byte, end_line, text, 1.0e0 AS score, 'explicit' AS source, 0 AS r FROM chunks WHERE path IN ('c00000001', 'c00000002') AND ordinal < 3
UNION ALL SELECT id, path, start_byte, start_line, end_byte, end_line, text, 1.0e0, 'pinned', 1 FROM chunks WHERE path IN ('c00000002', 'c00000005') AND ordinal < 3 UNION ALL SELECT c.id, path, start_byte, start_line, end_byte, end_line, text, h.score, 'primary', 2 FROM chunks c JOIN hits h ON c.id = h.id)"""
_FIRST = _TIERS + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, score DESC, path, start_byte) AS n FROM tiers), firsts AS (SELECT * FROM ranked WHERE n = 1)"


def _tiers(spark, sf_dir):
    chunks = Roles(spark, sf_dir).chunks()
    paths = lambda *n: spark.range(1).select(F.explode(F.array(*[F.lit(f"c{i:08d}") for i in n])).alias("path"))
    hits = chunks.where("ordinal % 2 = 1").select("id", ((F.substring("path", 2, 8).cast("long") % 10).cast("double") / 10).alias("score"))
    return A.tiers(chunks, paths(1, 2), paths(2, 5), hits, 3)


@query(f"WITH {_TIERS} SELECT id, path, source, score FROM tiers")
def tiered_union(spark, sf_dir):
    return _tiers(spark, sf_dir).select("id", "path", "source", "score")


@query(f"WITH {_FIRST} SELECT id, path, source, score FROM firsts")
def dedup_blocks(spark, sf_dir):
    return A.first_of_each(_tiers(spark, sf_dir)).select("id", "path", "source", "score")


@query(f"WITH {_FIRST} SELECT id, source, CAST(row_number() OVER (ORDER BY r, score DESC, path, start_byte) AS INTEGER) AS place FROM firsts ORDER BY place LIMIT 50")
def order_blocks(spark, sf_dir):
    from pyspark.sql import Window

    top = A.first_of_each(_tiers(spark, sf_dir))
    top = top.orderBy(*A.in_order(top)).limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*A.in_order(top))).cast("int")).select("id", "source", "place")  # at most 50 rows


@query(f"WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ordinal) AS n FROM chunks) SELECT path, id, ordinal FROM r WHERE n <= 3")
def chunks_for_files(spark, sf_dir):
    c = Roles(spark, sf_dir).chunks()
    return A.first_chunks(c, c.select("path"), 3).select("path", "id", "ordinal")


@query(f"WITH {CHUNKS}, {{lines}}".replace("{lines}", "l AS (SELECT *, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) AS lines FROM chunks), h AS (SELECT id, start_line, start_byte, unnest(range(1, len(lines) + 1)) AS n, lines FROM l), f AS (SELECT id, start_line, start_byte, array_to_string(lines[1:n], chr(10)) AS t, n FROM h), b AS (SELECT id, MAX(n) AS n FROM f WHERE strlen(t) <= 200 GROUP BY id)") + " SELECT f.id, CAST(f.start_line + f.n - 1 AS INTEGER) AS end_line, CAST(f.start_byte + strlen(t) AS BIGINT) AS end_byte, sha256(t) AS text_hash FROM f JOIN b ON f.id = b.id AND f.n = b.n WHERE t <> ''")
def trim_block_bytes(spark, sf_dir):
    c = Roles(spark, sf_dir).chunks().withColumn("text", F.regexp_replace("text", r"\. ", ".\n"))
    return A.trimmed_bytes(c, 200).select("id", "end_line", "end_byte", F.sha2("text", 256).alias("text_hash"))


_BLOCKS = "blk AS (SELECT path, id, start_byte, end_byte FROM chunks WHERE ordinal % 3 = 0)"
_SYMS = "sym AS (SELECT path, kind || '_' || CAST(ordinal AS VARCHAR) AS name, start_byte + 10 AS s0, end_byte + 10 AS s1 FROM chunks)"


def _blocks_symbols(spark, sf_dir):
    c = Roles(spark, sf_dir).chunks()
    return c, c.where("ordinal % 3 = 0"), c.select("path", F.concat("kind", F.lit("_"), F.col("ordinal").cast("string")).alias("name"), (F.col("start_byte") + 10).alias("start_byte"), (F.col("end_byte") + 10).alias("end_byte"))


@query(f"WITH {CHUNKS}, {_BLOCKS}, {_SYMS} SELECT b.id AS block_id, name, s0 AS start_byte, s1 AS end_byte FROM blk b JOIN sym s ON b.path = s.path AND s0 < end_byte AND s1 > start_byte")
def symbols_in_range(spark, sf_dir):
    _, blocks, symbols = _blocks_symbols(spark, sf_dir)
    return A.symbols_in(blocks, symbols)


_LANGS = "langs AS (SELECT DISTINCT path, CASE CAST(substr(path, 2) AS BIGINT) % 3 WHEN 0 THEN 'Rust' ELSE 'klingon' END AS language FROM chunks WHERE CAST(substr(path, 2) AS BIGINT) % 3 < 2)"
_RICH = f"{CHUNKS}, {_BLOCKS}, {_SYMS}, {_LANGS}, names AS (SELECT b.id, string_agg(DISTINCT name, ', ' ORDER BY name) AS symbols FROM blk b JOIN sym s ON b.path = s.path AND s0 < end_byte AND s1 > start_byte GROUP BY b.id), rich AS (SELECT c.id, c.path, 'primary' AS source, c.ordinal / 10.0e0 AS relevance0, c.end_line, COALESCE(l.language, 'text') AS language, COALESCE(n.symbols, '') AS symbols, c.text FROM chunks c LEFT JOIN names n ON c.id = n.id LEFT JOIN langs l ON c.path = l.path WHERE c.ordinal % 3 = 0)"


def _rich(spark, sf_dir):
    c, blocks, symbols = _blocks_symbols(spark, sf_dir)
    n = F.substring("path", 2, 8).cast("long") % 3
    languages = c.where(n < 2).select("path", F.when(n == 0, "Rust").otherwise("klingon").alias("language")).distinct()
    return A.enrich(blocks.withColumns({"score": F.col("ordinal") / 10.0, "source": F.lit("primary")}), symbols, languages)


@query(f"WITH {_RICH} SELECT id, path, round(greatest(least(relevance0, 1), 0), 6) AS relevance, language, symbols FROM rich")
def enrich_blocks(spark, sf_dir):
    return _rich(spark, sf_dir).select("id", "path", F.round("relevance", 6).alias("relevance"), "language", "symbols")


@query(f"""WITH {_RICH} SELECT id, printf('<BLOCK>' || chr(10) || 'path: %s' || chr(10) || 'Lines: %d-%d' || chr(10) || 'relevance: %.4f' || chr(10) || 'source: primary' || chr(10) || 'reason: retrieval' || chr(10) || 'language: %s' || chr(10), path, 1, end_line, greatest(least(relevance0, 1), 0), language) || CASE WHEN symbols <> '' THEN 'symbols: ' || symbols || chr(10) ELSE '' END || '```' || CASE language WHEN 'Rust' THEN 'rust' ELSE 'text' END || chr(10) || text || chr(10) || '```' || chr(10) || '</BLOCK>' AS markdown FROM rich""")
def render_blocks(spark, sf_dir):
    rows = _rich(spark, sf_dir)
    return rows.select("id", A.render({c: F.col(c) for c in rows.columns}).alias("markdown"))


@query(f"WITH {COCHANGE}, two AS (SELECT src, dst, weight FROM pairs UNION ALL SELECT dst, src, weight FROM pairs), near AS (SELECT dst AS path, SUM(weight) AS w FROM two WHERE src IN ('f1', 'f2', 'f3', 'f4', 'f5') GROUP BY dst ORDER BY round(SUM(weight), 9) DESC, path LIMIT 40) SELECT path FROM near WHERE starts_with(path, 'f1') AND NOT starts_with(path, 'f19')")
def expand_cochange(spark, sf_dir):
    seeds = spark.range(1, 6).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"))
    edges = _cochange_of(spark, sf_dir, seeds)
    near = H.both_ways(edges).join(F.broadcast(seeds), F.col("src") == F.col("path"), "left_semi").groupBy(F.col("dst").alias("path")).agg(F.round(F.sum("weight"), 9).alias("w"))
    # the limit comes first, then the filter
    return near.orderBy(F.desc("w"), "path").limit(40).where(P.allowed(F.col("path"), ["f1"], ["f19"])).select("path")


_HEAD = "(SELECT CASE WHEN n IS NULL OR array_to_string(ls[1:n], chr(10)) = '' THEN NULL ELSE array_to_string(ls[1:n], chr(10)) END FROM (SELECT list_max(list_filter(range(1, len(ls) + 1), lambda k: {size}(array_to_string(ls[1:k], chr(10))) <= {most})) AS n, ls FROM (SELECT string_split({text}, chr(10)) AS ls)))"
_WARN = "CASE WHEN t2 IS NULL AND source IN ('explicit', 'pinned') THEN source || ' dropped due to ' || CASE WHEN t1 IS NULL THEN 'token' ELSE 'byte' END || ' budget: ' || path END"


def _fits(before: str, size: str, room: int, used: str) -> str:
    head = _HEAD.format(size=size, most=f"{room} - {used}", text=before)
    return f"CASE WHEN {used} + {size}({before}) <= {room} THEN {before} WHEN source = 'expanded' THEN NULL ELSE {head} END"


@query(f"""WITH RECURSIVE {_FIRST}, o AS (SELECT row_number() OVER (ORDER BY r, score DESC, path, start_byte) AS n, id, path, source, score, start_line, end_line, start_byte, replace(text, '. ', '.' || chr(10)) AS t FROM firsts),
f AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS took, CAST(0 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS warning UNION ALL
SELECT n, tokens + COALESCE(length(t2), 0), bytes + COALESCE(strlen(t2), 0), took + CASE WHEN t2 IS NULL THEN 0 ELSE 1 END, place + CASE WHEN t2 IS NULL AND {_WARN} IS NULL THEN 0 ELSE 1 END, t2, {_WARN} FROM
(SELECT *, {_fits("t1", "strlen", 9000, "bytes")} AS t2 FROM (SELECT o.n, o.path, o.source, f.tokens, f.bytes, f.took, f.place, {_fits("o.t", "length", 5500, "f.tokens")} AS t1 FROM f JOIN o ON o.n = f.n + 1 WHERE f.took < 40)))
SELECT CAST(place AS INTEGER) AS place, CASE WHEN f.text IS NOT NULL THEN id END AS id, CASE WHEN f.text IS NOT NULL THEN path END AS path, CASE WHEN f.text IS NOT NULL THEN source END AS source, CASE WHEN f.text IS NOT NULL THEN round(score, 6) END AS score,
CASE WHEN f.text = t THEN end_line WHEN f.text IS NOT NULL THEN CAST(start_line + len(string_split(f.text, chr(10))) - 1 AS INTEGER) END AS end_line, CASE WHEN f.text IS NOT NULL THEN CAST(start_byte + strlen(f.text) AS BIGINT) END AS end_byte, warning FROM f JOIN o USING (n) WHERE f.text IS NOT NULL OR warning IS NOT NULL""")
def budget_blocks(spark, sf_dir):
    blocks = _tiers(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"\. ", ".\n"))
    return A.budget(blocks, 6000, 9000, 40, reserved=500).select("place", "id", "path", "source", F.round("score", 6).alias("score"), "end_line", "end_byte", "warning")


_FULL = "f.k >= 15 OR f.total + e.tokens > 300"


@query(f"""WITH RECURSIVE e AS (SELECT user_id % 64 AS lane, event_id AS id, CAST(floor(abs(value)) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY user_id % 64 ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT lane, id, n, 1 AS k, tokens AS total, 0 AS batch FROM e WHERE n = 1 UNION ALL SELECT e.lane, e.id, e.n, CASE WHEN {_FULL} THEN 1 ELSE f.k + 1 END, CASE WHEN {_FULL} THEN e.tokens ELSE f.total + e.tokens END, CASE WHEN {_FULL} THEN f.batch + 1 ELSE f.batch END FROM f JOIN e ON e.lane = f.lane AND e.n = f.n + 1) SELECT lane, id, batch FROM f""")
def token_batches(spark, sf_dir):
    e = Roles(spark, sf_dir).read("events").select((F.col("user_id") % 64).alias("lane"), F.unix_micros(F.col("ts").cast("timestamp")).alias("place"), F.col("event_id").alias("id"), F.floor(F.abs("value")).cast("long").alias("tokens"))
    return A.token_batches(e, 15, 300)


_SUMMARY = f"""{pagerank_sql()}, {COMMITS.replace('commits AS', 'fcommits AS')}, files AS (SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS path FROM nation), ncommits AS (SELECT DISTINCT 'n' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS path, o_orderkey AS commit_id FROM orders JOIN customer ON o_custkey = c_custkey),
nn AS (SELECT path, n_regionkey, n_nationkey FROM files JOIN nation ON path = 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')), co AS (SELECT a.path AS src, b.path AS dst, ((a.n_nationkey + b.n_nationkey) % 7) / 7.0e0 AS w FROM nn a JOIN nn b ON a.n_regionkey = b.n_regionkey AND a.path <> b.path),
top AS (SELECT path, rank, row_number() OVER (ORDER BY round(rank, 12) DESC, path) AS place FROM p20 ORDER BY place LIMIT 20), part AS (SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) AS n FROM co), partners AS (SELECT src AS path, string_agg(printf('%s (%.2f)', dst, w), ', ' ORDER BY n) AS partners FROM part WHERE n <= 3 GROUP BY src), churn AS (SELECT path, COUNT(*) AS n FROM ncommits GROUP BY path)"""


def _summary(spark, sf_dir):
    r = Roles(spark, sf_dir)
    n = lambda c: F.concat(F.lit("n"), F.lpad(F.col(c).cast("string"), 2, "0"))
    commits = r.read("orders").join(r.read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(n("c_nationkey").alias("path"), F.col("o_orderkey").alias("commit_id"))
    cochange = r.nation_cochange().select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    return R.summary(r.read("nation").select(n("n_nationkey").alias("path")), r.dependencies(), commits, cochange)


@query(f"WITH {_SUMMARY} SELECT f.path, round(rank, 6) AS rank, CASE WHEN rank IS NULL THEN '' ELSE concat_ws(' ', CASE WHEN place <= 5 THEN '[core]' END, CASE WHEN c.n >= 10 THEN '[high-churn]' END) END AS badges, CASE WHEN rank IS NULL THEN '' ELSE COALESCE(partners, '') END AS partners FROM files f LEFT JOIN top t ON f.path = t.path LEFT JOIN churn c ON f.path = c.path LEFT JOIN partners p ON f.path = p.path")
def repo_summary(spark, sf_dir):
    return _summary(spark, sf_dir).withColumn("rank", F.round("rank", 6))


_TICK = "CASE WHEN {0} THEN '└── ' ELSE '├── ' END"
_BAR = "CASE WHEN {0} THEN '    ' ELSE '│   ' END"


@query(f"""WITH {FILES}, p AS (SELECT string_split(path, '/') AS k FROM files), f AS (SELECT DISTINCT k[1] AS a, k[2] AS b, k[3] AS c FROM p), t AS (SELECT *, a = MAX(a) OVER () AS la, b = MAX(b) OVER (PARTITION BY a) AS lb, c = MAX(c) OVER (PARTITION BY a, b) AS lc FROM f),
lines AS (SELECT DISTINCT a, '' AS b, '' AS c, {_TICK.format("la")} || a || '/' AS line FROM t UNION ALL SELECT DISTINCT a, b, '', {_BAR.format("la")} || {_TICK.format("lb")} || b || '/' FROM t UNION ALL SELECT a, b, c, {_BAR.format("la")} || {_BAR.format("lb")} || {_TICK.format("lc")} || c FROM t)
SELECT CAST(row_number() OVER (ORDER BY a, b, c) AS INTEGER) AS line_no, line FROM lines ORDER BY line_no LIMIT 400""")
def repo_tree_lines(spark, sf_dir):
    files = Roles(spark, sf_dir).files().select("path", F.lit(None).cast("double").alias("rank"), F.lit("").alias("badges"), F.lit("").alias("partners"))
    return R.repo_tree(files)


@query(f"""WITH {FILES}, picked AS (SELECT 'c' || lpad(CAST(n AS VARCHAR), 8, '0') AS path, n / 10.0e0 AS weight, CASE WHEN n = 3 THEN 'pinned' ELSE 'expanded' END AS source FROM (SELECT unnest(range(0, 8)) AS n)), {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ordinal) AS k FROM chunks) SELECT r.id, r.path, p.source, CAST(p.weight AS DOUBLE) AS score FROM r JOIN picked p ON r.path = p.path WHERE k <= 2""")
def topology_blocks(spark, sf_dir):
    picked = spark.range(8).select(F.format_string("c%08d", "id").alias("path"), (F.col("id") / 10.0).alias("weight"))
    sources = spark.range(1).select(F.lit("c00000003").alias("path"), F.lit("pinned").alias("source"))
    return T.blocks(Roles(spark, sf_dir).chunks(), picked, sources, 2).select("id", "path", "source", "score")
