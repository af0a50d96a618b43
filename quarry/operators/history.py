"""Change history: commits, co-change edges and their neighbours."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW_SEEDS = 100_000


def file_commit_edges(commits: DataFrame) -> DataFrame:
    return commits.select("path", "commit_id").distinct()


def small_commits(edges: DataFrame, known_files: int, ratio: float) -> DataFrame:
    """(commit_id, n_files) of the commits that touch no more than ceil(known * ratio) files, at least 1; a ratio of 1 or more sets no limit."""
    sizes = edges.groupBy("commit_id").agg(F.countDistinct("path").alias("n_files"))
    return sizes if ratio >= 1 else sizes.where(F.col("n_files") <= max(1, math.ceil(known_files * ratio)))


def cochange_edges(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(src, dst, commit_count, weight): every pair of files of a commit weighs one over the commit's files, known or not.

    The pairs of a commit are made from its own sorted files, so files are shuffled once by commit
    and the number of pairs is bounded by the commit sizes that `sizes` lets through.
    """
    files = edges.join(sizes, "commit_id").groupBy("commit_id", "n_files").agg(F.array_sort(F.collect_set("path")).alias("files"))
    first = files.select("n_files", "files", F.posexplode("files").alias("at", "src"))
    pairs = first.select("n_files", "src", F.explode(F.slice("files", F.col("at") + 2, F.size("files"))).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("commit_count"), F.sum(1.0 / F.col("n_files")).alias("weight"))


def of_seeds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The whole of the commits that hold any of seeds(path): all that the seeds' co-change edges rest on, so no pair of other commits is made."""
    commits = edges.join(_few(seeds.select("path").distinct()), "path", "left_semi").select("commit_id").distinct()
    return edges.join(commits, "commit_id", "left_semi")


def _few(seeds: DataFrame) -> DataFrame:
    """seeds, to be broadcast if at most FEW_SEEDS (counted)."""
    return F.broadcast(seeds) if seeds.limit(FEW_SEEDS + 1).count() <= FEW_SEEDS else seeds


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def neighbours(edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """(path, weight) of the files that change most with seeds(path); seeds may be among them. More than FEW_SEEDS are shuffled, not broadcast."""
    near = both_ways(edges).join(_few(seeds.select(F.col("path").alias("src"))), "src")
    return near.groupBy(F.col("dst").alias("path")).agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "path").limit(limit)


def upsert_edges(known: DataFrame, found: DataFrame) -> DataFrame:
    """found overwrites known pairs; others stay."""
    return known.join(found.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(found)


def undirected_max(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("weight"))
