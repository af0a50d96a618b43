"""Queries of history, dependencies and retrieval filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import deps as D
from ..operators import history as H
from ..sources.catalog import Roles
from .registry import COCHANGE, COMMITS, DEPS, FILES, NAMED, query

COMMIT_INFO = "info AS (SELECT o_orderkey AS commit_id, o_orderpriority AS message, c_mktsegment AS author, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"WITH {COMMITS}, {COMMIT_INFO} SELECT c.commit_id, c.path FROM commits c JOIN info i USING (commit_id) WHERE n <= 10240 AND regexp_matches(message, '^[12]-') AND regexp_matches(author, 'BUILD|AUTO') AND (path LIKE 'f1%' OR path LIKE 'f2%')")
def history_filtered(spark, sf_dir):
    r = Roles(spark, sf_dir)
    newest = r.read("orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10240)
    info = newest.join(r.read("customer"), F.col("o_custkey") == F.col("c_custkey")).where(F.col("o_orderpriority").rlike("^[12]-") & F.col("c_mktsegment").rlike("BUILD|AUTO")).select(F.col("o_orderkey").alias("commit_id"))
    return r.commits().where(P.in_prefixes(F.col("path"), "f1, f2".split(","))).join(info, "commit_id", "left_semi").select("commit_id", "path")


def _sizes(r, ratio=1.0):
    edges = r.commits()
    known = edges.select("path").distinct().count() if ratio < 1 else 0
    return edges, H.small_commits(edges, known, ratio)


@query(f"WITH {COMMITS} SELECT commit_id, COUNT(DISTINCT path) AS n_files FROM commits GROUP BY 1 HAVING COUNT(DISTINCT path) <= (SELECT greatest(1, ceil(COUNT(DISTINCT path) * 0.002e0)) FROM commits)")
def commit_size_filter(spark, sf_dir):
    return _sizes(Roles(spark, sf_dir), 0.002)[1]


@query(f"WITH {COMMITS} SELECT commit_id, path FROM commits")
def file_commit_edges(spark, sf_dir):
    return H.file_commit_edges(Roles(spark, sf_dir).commits())


@query(f"WITH {COMMITS} SELECT path, COUNT(*) AS n_commits FROM commits GROUP BY path")
def file_commit_count(spark, sf_dir):
    return Roles(spark, sf_dir).commits().groupBy("path").agg(F.count("*").alias("n_commits"))


def _cochange(spark, sf_dir):
    return H.cochange_edges(*_sizes(Roles(spark, sf_dir)))


def _cochange_of(spark, sf_dir, seeds):
    """The co-change edges with an end among the seeds; the weights of others are partial."""
    edges = H.of_seeds(Roles(spark, sf_dir).commits(), seeds)
    return H.cochange_edges(edges, H.small_commits(edges, 0, 1.0))


@query(f"WITH {COCHANGE} SELECT src, dst, commit_count, round(weight, 6) AS weight FROM pairs")
def cochange_edges(spark, sf_dir):
    return _cochange(spark, sf_dir).withColumn("weight", F.round("weight", 6))


_BOTH = "two AS (SELECT src, dst, weight FROM pairs UNION ALL SELECT dst, src, weight FROM pairs)"


@query(f"WITH {COCHANGE}, {_BOTH} SELECT dst AS path, round(SUM(weight), 6) AS weight FROM two WHERE src IN ('f1', 'f2', 'f3', 'f4', 'f5') GROUP BY dst ORDER BY round(SUM(weight), 9) DESC, path LIMIT 25")
def cochange_neighbors(spark, sf_dir):
    seeds = spark.range(1, 6).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"))
    edges = _cochange_of(spark, sf_dir, seeds)
    near = H.both_ways(edges).join(F.broadcast(seeds.select(F.col("path").alias("src"))), "src").groupBy(F.col("dst").alias("path")).agg(F.round(F.sum("weight"), 9).alias("weight"))
    return near.orderBy(F.desc("weight"), "path").limit(25).withColumn("weight", F.round("weight", 6))


@query(f"WITH {COCHANGE}, {_BOTH} SELECT dst AS path, round(SUM(weight), 6) AS weight FROM two WHERE src = 'f7' GROUP BY dst ORDER BY round(SUM(weight), 9) DESC, path LIMIT 3")
def cochange_partners(spark, sf_dir):
    seed = spark.range(1).select(F.lit("f7").alias("path"))
    return H.neighbours(_cochange_of(spark, sf_dir, seed).withColumn("weight", F.round("weight", 9)), seed, 3).withColumn("weight", F.round("weight", 6))


@query(f"WITH {COCHANGE} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(MAX(weight), 6) AS weight FROM pairs GROUP BY 1, 2")
def cochange_undirected_max(spark, sf_dir):
    return H.undirected_max(_cochange(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {COCHANGE} SELECT src, dst, CASE WHEN src < 'f2' THEN commit_count + 1 ELSE commit_count END AS commit_count, round(CASE WHEN src < 'f2' THEN 1.0e0 ELSE weight END, 6) AS weight FROM pairs")
def upsert_history(spark, sf_dir):
    known = _cochange(spark, sf_dir)
    found = known.where(F.col("src") < "f2").select("src", "dst", (F.col("commit_count") + 1).alias("commit_count"), F.lit(1.0).alias("weight"))
    return H.upsert_edges(known, found).withColumn("weight", F.round("weight", 6))


_RD = NAMED + ", r AS (SELECT src, name, COUNT(*) AS n FROM named GROUP BY 1, 2), d AS (SELECT DISTINCT dst, name FROM named)"


@query(f"WITH {_RD} SELECT src, dst, CAST(SUM(n) AS BIGINT) AS reference_count FROM r JOIN d USING (name) WHERE src <> dst GROUP BY 1, 2")
def dependency_edges(spark, sf_dir):
    r = Roles(spark, sf_dir)
    return D.edges(r.references(), r.definitions())


@query(f"WITH {_RD} SELECT src, dst, CAST(SUM(n) AS BIGINT) AS reference_count FROM r JOIN d USING (name) WHERE src <> dst AND dst = 'n07' GROUP BY 1, 2")
def dependency_edges_incoming(spark, sf_dir):
    r = Roles(spark, sf_dir)
    # every definition twice: distinct counts a reference once
    d = r.definitions().where("path = 'n07'")
    return D.edges(r.references(), d.unionByName(d), distinct=True)


@query(f"WITH {_RD}, deps AS {DEPS.split(', deps AS ', 1)[1]}, fresh AS (SELECT src, dst, CAST(SUM(n) AS BIGINT) AS c FROM r JOIN d USING (name) WHERE src <> dst GROUP BY 1, 2) SELECT src, dst, weight AS reference_count FROM deps WHERE src <> 'n03' AND dst <> 'n03' UNION ALL SELECT src, dst, c FROM fresh WHERE src = 'n03' OR dst = 'n03'")
def dependency_edges_incremental(spark, sf_dir):
    r = Roles(spark, sf_dir)
    known = r.dependencies().select("src", "dst", F.col("weight").alias("reference_count"))
    return D.refreshed(known, r.references(), r.definitions(), "n03")


@query("""WITH s AS (SELECT 'b' || CAST(l_orderkey % 50 AS VARCHAR) AS path, CAST(l_suppkey AS VARCHAR) AS name, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id FROM lineitem),
u AS (SELECT path, name, MIN(id) AS symbol_id FROM s WHERE hash_ok GROUP BY 1, 2 HAVING COUNT(DISTINCT id) = 1) SELECT s.id AS reference_id, u.symbol_id FROM s JOIN u USING (path, name)""".replace("WHERE hash_ok ", "WHERE ends_with(id, '-1') "))
def unique_reference_links(spark, sf_dir):
    rows = Roles(spark, sf_dir).read("lineitem").select(F.concat(F.lit("b"), (F.col("l_orderkey") % 50).cast("string")).alias("path"), F.col("l_suppkey").cast("string").alias("name"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    return D.unique_links(rows, rows.where(F.col("id").endswith("-1")))


URLS = "urls AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"


def _urls(spark, sf_dir):
    return Roles(spark, sf_dir).read("pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


@query(f"WITH {URLS} SELECT page_id, path FROM urls WHERE starts_with(path, 'blog.') OR starts_with(path, 'm.')")
def path_prefix_filter(spark, sf_dir):
    return _urls(spark, sf_dir).where(P.in_prefixes(F.col("path"), [" blog. ", "m.", ""]))


@query(f"WITH {FILES} SELECT doc_id, path FROM files WHERE language IN ('en', 'fr')")
def file_ext_filter(spark, sf_dir):
    return Roles(spark, sf_dir).files().where(P.in_extensions(F.col("path"), [".RS", "py"])).select("doc_id", "path")


@query(f"WITH {FILES} SELECT path FROM files WHERE starts_with(path, 'src1') AND NOT starts_with(path, 'src1/en') AND NOT starts_with(path, 'src12')")
def scope_exclude_filter(spark, sf_dir):
    return Roles(spark, sf_dir).files().where(P.allowed(F.col("path"), ["src1"], ["src1/en", "src12"])).select("path")


_TESTS = "CASE doc_id % 8 WHEN 0 THEN 'a/tests/x_' || doc_id || '.py' WHEN 1 THEN 'b/test_' || doc_id || '.rs' WHEN 2 THEN 'c/x' || doc_id || '_test.go' WHEN 3 THEN 'd/x' || doc_id || '.spec.ts' WHEN 4 THEN 'e/__TESTS__/q.js' WHEN 5 THEN 'test/plain' || doc_id || '.c' WHEN 6 THEN 'f/Test_' || doc_id || '.py' ELSE 'g/contest' || doc_id || '.h' END"


@query(f"SELECT doc_id, {_TESTS} AS path, doc_id % 8 <= 4 AS is_test FROM documents")
def test_path_flag(spark, sf_dir):
    rows = Roles(spark, sf_dir).read("documents").select("doc_id", F.expr(_TESTS).alias("path"))
    return rows.withColumn("is_test", P.is_test(F.col("path")))


_NAMES = "CASE doc_id % 6 WHEN 0 THEN 'a/Cargo.toml' WHEN 1 THEN 'web/package.json' WHEN 2 THEN 'x/main.cpp' WHEN 3 THEN 'Dockerfile' WHEN 4 THEN 'db/' || doc_id || '.SQL' ELSE 'readme' END"


@query("SELECT unnest(['C++', 'Docker', 'Node.js', 'Rust', 'SQL']) AS technology")
def tech_stack(spark, sf_dir):
    rows = Roles(spark, sf_dir).read("documents").select(F.expr(_NAMES).alias("path"))
    return rows.select(F.explode(P.technologies(F.col("path"))).alias("technology")).distinct().orderBy("technology")


@query(f"WITH {FILES} SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN replace('/other/' || path, '\\', '/') ELSE replace(path, '\\', '/') END AS shown FROM files")
def display_path(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/repo/root/"), "path")).when(F.col("doc_id") % 3 == 1, F.replace(F.col("path"), F.lit("/"), F.lit("\\"))).otherwise(F.concat(F.lit("/other/"), "path"))
    return Roles(spark, sf_dir).files().select("doc_id", P.display(raw, "/repo/root").alias("shown"))


@query(f"WITH {FILES}, w AS (SELECT source || '/' || lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.rs' AS path FROM documents) SELECT 'include not found: ' || path AS warning FROM w WHERE path NOT IN (SELECT path FROM files)")
def missing_includes(spark, sf_dir):
    from ..operators.assembly import missing

    r = Roles(spark, sf_dir)
    wanted = r.read("documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".rs")).alias("path"))
    return missing(wanted, r.files(), "include")
