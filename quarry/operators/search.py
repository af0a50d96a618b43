"""Retrieval: BM25 over postings, exact vector top-k, hybrid scores, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from .checkpoints import pinned

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _times(term: str) -> Column:
    return F.size(F.filter("asked", lambda t: t == F.lit(term)))


def bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(id, bm25) of docs(id, text) that hold any of the terms; greater is better.

    One pass counts the few terms in every document; its counts, a few numbers a document, are
    written down, so the texts are read once for the totals and for the scores.
    """
    terms = list(dict.fromkeys(terms))
    words = docs.select("id", T.tokens(F.col("text")).alias("w"))
    # the words asked for are picked in one pass over a document's words and told apart among those few
    words = words.select("id", F.size("w").alias("len"), F.filter("w", lambda t: t.isin(terms)).alias("asked"))
    counted = pinned(words.select("id", "len", *[_times(x).alias(f"t{i}") for i, x in enumerate(terms)]))
    totals = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count(F.when(F.col(f"t{i}") > 0, 1)).alias(f"d{i}") for i in range(len(terms))])
    hits = counted.where(" or ".join(f"t{i} > 0" for i in range(len(terms))) or "false").crossJoin(F.broadcast(totals))  # totals is one row
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)), F.lit(LEAST_IDF))
        tf = F.col(f"t{i}").cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return hits.select("id", score.alias("bm25"))


def fts_score(bm25_: Column, compat: bool = False) -> Column:
    """In [0, 1) and rising with relevance; compat is 1 / (1 + bm25) of a negative bm25, with its pole."""
    return 1.0 / (1.0 - bm25_) if compat else bm25_ / (1.0 + bm25_)


def fts_topk(docs: DataFrame, terms: list[str], k: int, compat: bool = False) -> DataFrame:
    return bm25(docs, terms).select("id", fts_score(F.col("bm25"), compat).alias("fts_score")).orderBy(F.desc("fts_score"), "id").limit(k)


def vector_topk(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(id, distance) of the k nearest of vectors(id, embedding) to the one row of query(embedding); each task keeps k."""
    q = F.broadcast(query.limit(1).select(F.col("embedding").alias("q")))
    return vectors.crossJoin(q).select("id", V.cosine_distance(F.col("embedding"), F.col("q")).alias("distance")).orderBy("distance", "id").limit(k)  # one row against all


def hybrid(vector: DataFrame, fts: DataFrame, weight: float, limit: int) -> DataFrame:
    """Both hit lists merged: the blend where a row is in both, its one score else. Hit lists are bounded by their limits."""
    w = min(1.0, max(0.0, weight))
    everything = Window.partitionBy(F.lit(0))
    top = F.greatest(F.max("fts_score").over(everything), F.lit(0.0))
    t = fts.select("id", F.when(top > 0, F.col("fts_score") / top).otherwise(F.lit(0.0)).alias("fts_score"))
    v = vector.select("id", V.similarity(F.col("distance")).alias("vector_score"))
    score = F.when(F.col("vector_score").isNull(), F.col("fts_score")).when(F.col("fts_score").isNull(), F.col("vector_score")).otherwise(w * F.col("vector_score") + (1 - w) * F.col("fts_score"))
    return v.join(t, "id", "full_outer").withColumn("score", V.clamp(score)).orderBy(F.desc("score"), "id").limit(limit)


def reranked(hits: DataFrame, keep: Column, scores: DataFrame, limit: int, least: float) -> DataFrame:
    """hits that keep lets through (after their limit), scored anew by scores(id, rerank) and cut at the least score."""
    kept = hits.where(keep).orderBy(F.desc("score"), "id").limit(limit)
    return kept.join(scores, "id", "left").withColumn("score", V.clamp(F.coalesce("rerank", F.lit(0.0)))).where(F.col("score") >= least).orderBy(F.desc("score"), "id")


def result_line(place: Column, path: Column, start: Column, end: Column, score: Column, vector: Column, fts: Column) -> Column:
    """One line of a result; the numbers after the path are bytes."""
    four = lambda label, c: F.when(c.isNotNull(), F.format_string(f" {label}=%.4f", c)).otherwise(F.lit(""))
    return F.concat(F.format_string("%d. %s:%d-%d score=%.4f", place, path, start, end, score), four("vec", vector), four("fts", fts))
