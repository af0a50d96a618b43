"""Files for a context from the dependency graph: seeds and what lies around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .assembly import first_chunks
from .checkpoints import pinned


def around(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(path, weight, distance) of the files within depth of any of seeds(path), without them: weights summed and distances the least over seeds."""
    near = pinned(graph.distances(edges, seeds, depth))
    ends = lambda c: near.select("seed", F.col("path").alias(c))
    inside = edges.join(ends("src"), "src").join(ends("dst"), ["seed", "dst"])
    weights = inside.select("seed", F.col("src").alias("path"), "weight").unionByName(inside.select("seed", F.col("dst").alias("path"), "weight")).groupBy("seed", "path").agg(F.sum("weight").cast("double").alias("w"))
    rows = near.where("distance > 0").join(weights, ["seed", "path"], "left").join(seeds.select("path"), "path", "left_anti")
    return rows.groupBy("path").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("weight"), F.min("distance").alias("distance"))


def select_files(edges: DataFrame, seeds: DataFrame, depth: int, limit: int, keep: Column | None = None) -> DataFrame:
    """(path, weight, distance): all seeds, then neighbours (nearer, heavier, by name) that keep lets through, up to limit files."""
    seeds = pinned(seeds.select("path").distinct())
    n = seeds.count()
    chosen = seeds.select("path", F.lit(1.0).alias("weight"), F.lit(0).alias("distance"))
    if n >= limit or depth <= 0:
        return chosen
    near = around(edges, seeds, depth)
    return chosen.unionByName((near if keep is None else near.where(keep)).orderBy("distance", F.desc("weight"), "path").limit(limit - n))


def blocks(chunks: DataFrame, selected: DataFrame, sources: DataFrame, per_file: int) -> DataFrame:
    """The first chunks of selected files, with their source (expanded unless sources(path, source) has another) and weight as score."""
    rows = first_chunks(chunks, selected, per_file).join(F.broadcast(selected.select("path", F.col("weight").alias("score"))), "path", "left").join(F.broadcast(sources), "path", "left")
    return rows.withColumns({"score": F.coalesce("score", F.lit(0.0)), "source": F.coalesce("source", F.lit("expanded"))})
