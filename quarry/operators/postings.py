"""Postings: the words of every document, kept by word, so that a search reads its own terms alone.

postings(term, id, tf) has one row for each distinct word of a document; lengths(id, n_words) has one
row for each document, also for those without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .checkpoints import pinned
from .search import B, K1, LEAST_IDF, fts_score


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf) of docs(id, text); repeats of a word are counted in each task before the shuffle."""
    return docs.select("id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame) -> DataFrame:
    """(id, n_words) of docs(id, text); a null text has no words."""
    return docs.select("id", F.greatest(F.size(T.tokens(F.col("text"))), F.lit(0)).alias("n_words"))


def laid_out(rows: DataFrame) -> DataFrame:
    """Postings in ranges of term and id: files and row groups hold few terms, which a filter on term skips, and a frequent term spreads over ranges by id."""
    return rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id")


def upkept(known: DataFrame, gone: DataFrame, found: DataFrame) -> DataFrame:
    """Postings or lengths without the documents gone(id) and those found anew, and with found."""
    replaced = gone.select("id").unionByName(found.select("id")).distinct()
    return known.join(replaced, "id", "left_anti").unionByName(found)


def bm25(rows: DataFrame, sizes: DataFrame, terms: list[str]) -> DataFrame:
    """(id, bm25) of the documents that hold any of the terms, from postings and lengths; greater is better.

    The filter on terms reaches the scan. Of the hits, only their counts are shuffled; the terms'
    frequencies (a row for each term asked for) and the totals (one row) are broadcast.
    """
    terms = list(dict.fromkeys(terms))
    hits = pinned(rows.where(F.col("term").isin(terms)))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    totals = sizes.agg(F.count("*").alias("n"), F.avg("n_words").alias("avg"))
    found = hits.join(F.broadcast(df), "term").join(sizes, "id").crossJoin(F.broadcast(totals))  # totals is one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    tf = F.col("tf").cast("double")
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_words") / F.col("avg")))
    # a document's parts, one for each term at most, are added in the order of the terms, so equal documents score alike
    place = F.array_position(F.lit(terms) if terms else F.array().cast("array<string>"), F.col("term"))
    return found.groupBy("id").agg(F.aggregate(F.array_sort(F.collect_list(F.struct(place.alias("p"), part.alias("s")))), F.lit(0.0), lambda a, x: a + x["s"]).alias("bm25"))


def fts_topk(rows: DataFrame, sizes: DataFrame, terms: list[str], k: int, compat: bool = False) -> DataFrame:
    return bm25(rows, sizes, terms).select("id", fts_score(F.col("bm25"), compat).alias("fts_score")).orderBy(F.desc("fts_score"), "id").limit(k)
