"""Dependency edges from references and definitions. Names are counted by file before any join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(references: DataFrame, definitions: DataFrame, distinct: bool = False) -> DataFrame:
    """(src, dst, reference_count): references (path, name) to definitions (path, name) in other files.

    A reference counts once for each definition of its name in the other file, or once if distinct.
    """
    r = references.groupBy(F.col("path").alias("src"), "name").agg(F.count("*").alias("r"))
    d = definitions.groupBy(F.col("path").alias("dst"), "name").agg(F.count("*").alias("d"))
    times = F.col("r") if distinct else F.col("r") * F.col("d")
    return r.join(d, "name").where("src <> dst").groupBy("src", "dst").agg(F.sum(times).alias("reference_count"))


def refreshed(known: DataFrame, references: DataFrame, definitions: DataFrame, path: str) -> DataFrame:
    """known edges with those of one file made anew: its outgoing edges count every definition, its incoming ones each name once. Without references and definitions in the file nothing changes."""
    r, d = references.where(F.col("path") == path), definitions.where(F.col("path") == path)
    if r.limit(1).count() + d.limit(1).count() == 0:
        return known
    rest = known.where((F.col("src") != path) & (F.col("dst") != path))
    return rest.unionByName(edges(r, definitions)).unionByName(edges(references, d, distinct=True))


def unique_links(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(reference_id, symbol_id) where exactly one symbol of the reference's file bears its name."""
    named = symbols.groupBy("path", "name").agg(F.min("id").alias("symbol_id"), F.max("id").alias("other")).where("symbol_id = other")
    return references.join(named, ["path", "name"]).select(F.col("id").alias("reference_id"), "symbol_id")
