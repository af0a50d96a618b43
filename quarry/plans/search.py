"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import vectors as V
from ..operators import postings as O
from ..operators import search as S
from ..sources.catalog import Roles
from .registry import FILES, query

TERMS = ["ation", "heinin", "thedon", "lowei", "quede"]
_LIST = ", ".join(f"'{t}'" for t in TERMS)
_BM25 = f"""words AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents), len AS (SELECT id, len(w) AS n, w FROM words), tot AS (SELECT COUNT(*) AS docs, AVG(n) AS avg_n FROM len),
tf AS (SELECT id, n, t, len(list_filter(w, lambda x: x = t)) AS tf FROM len, (SELECT unnest([{_LIST}]) AS t)), df AS (SELECT t, COUNT(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY t),
bm AS (SELECT id, SUM(greatest(ln((docs - df + 0.5e0) / (df + 0.5e0)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * n / avg_n))) AS s FROM tf JOIN df USING (t), tot WHERE tf > 0 GROUP BY id)"""
_DOT = "list_inner_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_VEC = "q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0), vec AS (SELECT vec_id AS id, 1 - " + _DOT.format("embedding", "qv") + " / sqrt(" + _DOT.format("embedding", "embedding") + " * " + _DOT.format("qv", "qv") + ") AS distance FROM embeddings, q)"


def _docs(spark, sf_dir):
    return Roles(spark, sf_dir).read("documents").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark, sf_dir):
    v = Roles(spark, sf_dir).read("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return v, v.where("id = 0").select("embedding")


def _six(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"WITH {_BM25} SELECT id, round(s / (1 + s), 6) AS fts_score FROM bm ORDER BY s DESC, id LIMIT 20")
def fts_topk(spark, sf_dir):
    return _six(S.fts_topk(_docs(spark, sf_dir), TERMS, 20), "fts_score")


@query(f"WITH {_BM25} SELECT id, round(1 / (1 - s), 6) AS fts_score FROM bm ORDER BY 1 / (1 - s) DESC, id LIMIT 20")
def fts_topk_compat(spark, sf_dir):
    return _six(S.fts_topk(_docs(spark, sf_dir), TERMS, 20, compat=True), "fts_score")


@query("SELECT doc_id AS id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY 1, 2")
def postings(spark, sf_dir):
    return O.postings(_docs(spark, sf_dir))


@query("SELECT doc_id AS id, CAST(COALESCE(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')), 0) AS INTEGER) AS n_words FROM documents")
def document_lengths(spark, sf_dir):
    return O.lengths(_docs(spark, sf_dir))


@query(f"WITH {_BM25} SELECT id, round(s / (1 + s), 6) AS fts_score FROM bm ORDER BY s DESC, id LIMIT 20")
def fts_topk_postings(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return _six(O.fts_topk(O.postings(docs), O.lengths(docs), TERMS, 20), "fts_score")


@query("SELECT doc_id AS id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(CASE WHEN lang = 'fr' THEN 'again ' || text ELSE text END), '[\\p{L}\\p{N}]+')) AS term FROM documents WHERE lang <> 'de') GROUP BY 1, 2")
def postings_upkeep(spark, sf_dir):
    docs = Roles(spark, sf_dir).read("documents").select(F.col("doc_id").alias("id"), "text", "lang")
    found = docs.where("lang = 'fr'").select("id", F.concat(F.lit("again "), "text").alias("text"))
    # a null language is neither gone nor kept in the SQL, so those rows go too
    return O.upkept(O.postings(docs), docs.where("coalesce(lang, 'de') = 'de'"), O.postings(found))


@query(f"WITH {_VEC} SELECT id, round(distance, 6) AS distance FROM vec ORDER BY vec.distance, id LIMIT 10")
def vector_topk(spark, sf_dir):
    return _six(S.vector_topk(*_vectors(spark, sf_dir), 10), "distance")


@query(f"WITH {_VEC} SELECT id, round(greatest(least(1 - distance / 2, 1), 0), 6) AS vector_score FROM vec")
def vector_score(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    rows = v.crossJoin(F.broadcast(q.select(F.col("embedding").alias("q"))))  # one row
    return rows.select("id", F.round(V.similarity(V.cosine_distance(F.col("embedding"), F.col("q"))), 6).alias("vector_score"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value, round(CAST(embedding[64] AS DOUBLE), 6) AS last_value FROM embeddings")
def embedding_json(spark, sf_dir):
    v = Roles(spark, sf_dir).read("embeddings").select("vec_id", F.from_json(F.to_json("embedding"), "array<float>").alias("e"))
    return v.select("vec_id", F.size("e").cast("long").alias("dims"), F.round(F.col("e")[0].cast("double"), 6).alias("first_value"), F.round(F.col("e")[63].cast("double"), 6).alias("last_value"))


_HYBRID = f"""{_VEC}, {_BM25}, v AS (SELECT id, greatest(least(1 - distance / 2, 1), 0) AS vector_score FROM vec ORDER BY distance, id LIMIT 200), f0 AS (SELECT id, s / (1 + s) AS f FROM bm ORDER BY s DESC, id LIMIT 200), f AS (SELECT id, CASE WHEN (SELECT MAX(f) FROM f0) > 0 THEN f / (SELECT MAX(f) FROM f0) ELSE 0 END AS fts_score FROM f0),
m AS (SELECT COALESCE(v.id, f.id) AS id, vector_score, fts_score, greatest(least(CASE WHEN v.id IS NULL THEN fts_score WHEN f.id IS NULL THEN vector_score ELSE 0.6e0 * vector_score + 0.4e0 * fts_score END, 1), 0) AS score FROM v FULL JOIN f ON v.id = f.id),
hits AS (SELECT * FROM m ORDER BY round(score, 9) DESC, id LIMIT 20)"""


def _hybrid(spark, sf_dir):
    v = S.vector_topk(*_vectors(spark, sf_dir), 200)
    return S.hybrid(v, S.fts_topk(_docs(spark, sf_dir), TERMS, 200), 0.6, 20)


@query(f"WITH {_HYBRID} SELECT id, round(vector_score, 6) AS vector_score, round(fts_score, 6) AS fts_score, round(score, 6) AS score FROM hits")
def hybrid_search(spark, sf_dir):
    return _six(_hybrid(spark, sf_dir), "vector_score", "fts_score", "score")


_RERANK = f"""{_HYBRID}, {FILES}, kept AS (SELECT h.*, path FROM hits h JOIN files ON h.id = doc_id WHERE path LIKE '%.rs' OR path LIKE '%.go' ORDER BY round(score, 9) DESC, id LIMIT 8),
rr AS (SELECT id, path, COALESCE((SELECT MAX(CASE WHEN quality = 1 THEN 0.9e0 ELSE 0.3e0 END) FROM labels l WHERE l.doc_id = id), 0) AS score FROM kept)"""


@query(f"WITH {_RERANK} SELECT id, path, score FROM rr WHERE score >= 0.25")
def search_reranked(spark, sf_dir):
    r = Roles(spark, sf_dir)
    hits = _hybrid(spark, sf_dir).join(r.files().select(F.col("doc_id").alias("id"), "path"), "id")
    scores = r.read("labels").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 0.9).otherwise(0.3)).alias("rerank"))
    return S.reranked(hits, P.in_extensions(F.col("path"), ["rs", "go"]), scores, 8, 0.25).select("id", "path", "score")


@query(f"""WITH {_HYBRID} SELECT id, printf('%d. doc_%d:%d-%d score=%.4f', place, id, 0, id * 10, score) || CASE WHEN vector_score IS NULL THEN '' ELSE printf(' vec=%.4f', vector_score) END || CASE WHEN fts_score IS NULL THEN '' ELSE printf(' fts=%.4f', fts_score) END AS line
FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS place FROM hits)""")
def search_result_lines(spark, sf_dir):
    from pyspark.sql import Window

    hits = _hybrid(spark, sf_dir).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # at most 20 rows
    id_ = F.col("id")
    return hits.select("id", S.result_line(F.col("place"), F.concat(F.lit("doc_"), id_.cast("string")), F.lit(0), id_ * 10, F.col("score"), F.col("vector_score"), F.col("fts_score")).alias("line"))
