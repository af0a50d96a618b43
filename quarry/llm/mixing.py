"""Mixing sources to target weights: a splitting tree over exact block quotas.

Each source's documents fall into blocks by a hash of their ids, and its blocks into a permuted
order. A source's target in words fixes how many passes it makes over its blocks (repeats) and how
many further blocks it draws; these block draws are its quota. The quotas of all sources are split
down a binary tree of output shards by multivariate hypergeometric draws: a node's draws decide how
many of each source's next block draws go to its left half, the others go right. So every block draw
lands in exactly one shard. What the mix takes of a document are the draws of its block that the
tree has dealt. Within a shard the order is a local shuffle.

Everything random is a hash of ids and the seed: reruns agree, whatever the partitions. A shard holds
about SHARD_WORDS words, and there are as many as that takes. The quotas, one number for each source,
go to every task; the tree is walked there, in the parts that the task's draws reach.

Defined cases: a null or empty text has 0 words and is never taken; a null source is a source of its
own, last in order; a null id is an id like any other; rows of one id, text and source are taken
equally often; sources without words take nothing; a very long document is drawn whole, as its block
is; an empty table gives an empty result; extra columns are kept by mix() and ignored by report().
"""

from __future__ import annotations

from math import exp, lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import WORD, bounded, own, pinned, scratch, unused

#: Weights of the sources in order of their names, repeating; a source repeats at most so often.
WEIGHTS, MOST_PASSES = (5, 2, 1), 3
#: Documents in a block and words in an output shard, about.
BLOCK_DOCS, SHARD_WORDS = 500, 2_000_000
SEED = 20


def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """sources(source, source_size, docs) with weight and target: all words shared by weight, at most `most` times a source's size, the excess reshared until none is above."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.row_number().over(order) - 1
    rows = pinned(sources.withColumn("weight", F.element_at(F.lit(list(weights)), (place % len(weights) + 1).cast("int")).cast("double")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * float(most)
    level = 0.0
    while True:
        # at this level the capped sources give up their excess; the level rises to reshare it
        got = rows.agg(F.sum(F.when(cap <= F.col("weight") * level, cap)), F.sum(F.when(cap > F.col("weight") * level, F.col("weight")))).first()
        fixed, open_weight = got[0] or 0.0, got[1] or 0.0
        if not open_weight:
            break
        higher = (total - fixed) / open_weight
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    return rows.withColumn("target", F.least(cap, F.col("weight") * level))


def halved(left: np.ndarray, lo: int, hi: int, seed: int) -> np.ndarray:
    """Of a node's quotas, those that go to its left half: drawn without replacement, source by source."""
    rest = int(left.sum())
    want = round(rest * ((lo + hi) // 2 - lo) / (hi - lo))
    rng = np.random.default_rng([seed, lo, hi])
    drawn = np.zeros(len(left), np.int64)
    for i, c in enumerate(left.tolist()):
        if want <= 0:
            break
        drawn[i] = hypergeometric(rng, c, rest - c, want)
        rest, want = rest - c, want - int(drawn[i])
    return drawn


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good; beyond the library's range by inversion outward from the mode."""
    if good == 0 or n == 0 or bad == 0:
        return min(good, n)
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    lo, hi = max(0, n - bad), min(good, n)
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    pick = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    p = exp(pick(good, mode) + pick(bad, n - mode) - pick(good + bad, n))
    u, up, down, pu, pd = rng.random() - p, mode, mode, p, p
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            pu *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up, u = up + 1, u - pu
            if u <= 0:
                return up
        if down > lo:
            pd *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down, u = down - 1, u - pd
            if u <= 0:
                return down
    return mode


def shards_of(quotas: np.ndarray, shards: int, seed: int, source: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shard of each block draw, the rank-th of its source: the tree is walked where there are draws."""
    out = np.zeros(len(rank), np.int64)
    open_ = [(0, shards, quotas.astype(np.int64), np.arange(len(rank)), rank.astype(np.int64))]
    while open_:
        lo, hi, left, at, place = open_.pop()
        if hi - lo == 1:
            out[at] = lo
            continue
        mid, drawn = (lo + hi) // 2, halved(left, lo, hi, seed)
        first = place < drawn[source[at]]
        for a, b, q, mine, less in ((lo, mid, drawn, first, 0), (mid, hi, left - drawn, ~first, drawn)):
            if mine.any():
                open_.append((a, b, q, at[mine], place[mine] - (less[source[at[mine]]] if b == hi else 0)))
    return out


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _mark(seed: int, *c) -> Column:
    return F.xxhash64(F.lit(seed), *c)


class Mix:
    """What a mix of docs draws: per_source, and for each block the passes and shards that the tree deals it."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, block_docs: int, shard_words: int):
        self.seed = seed
        at = lambda c: F.col(f"`{c}`")
        self.rows = rows = pinned(docs.select(at(id_col).alias("id"), at(source_col).alias("source"), _key(at(source_col)).alias("sk"), sizes(at(text_col)).alias("size"), F.xxhash64(at(text_col)).alias("th")), outlives=True)
        aims = targets(rows.groupBy("source", "sk").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
        passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
        aims = aims.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs))).withColumn("passes", F.least(passes, F.lit(MOST_PASSES)))
        self.aims = pinned(aims.withColumn("rest", F.when(F.col("passes") < MOST_PASSES, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(F.lit(0.0))), outlives=True)
        placed = self.placed(rows)
        # blocks in permuted order: whole blocks up to the rest of the target, then documents of one more; sums by ranges of the order
        blocks = placed.groupBy("sk", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes")).withColumn("mark", _mark(seed, "block")).withColumn("range", F.shiftright("mark", 56))
        blocks = pinned(blocks)
        before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranges = blocks.groupBy("sk", "range").agg(F.sum("words").alias("rw"), F.count("*").alias("rn"))
        over = Window.partitionBy("sk").orderBy("range")
        ranges = ranges.select("sk", "range", before(over, "rw").alias("rw"), before(over, "rn").alias("rn"))
        inside = Window.partitionBy("sk", "range").orderBy("mark", "block")
        blocks = blocks.join(ranges, ["sk", "range"]).withColumn("before", F.col("rw") + before(inside, "words")).withColumn("place", F.col("rn") + F.row_number().over(inside) - 1)
        blocks = pinned(blocks.select("sk", "block", "words", "passes", "before", "place", (F.col("before") + F.col("words") <= F.col("rest")).alias("whole"), (F.col("before") < F.col("rest")).alias("begun")))
        # a block's draws have the ranks of its place in each pass
        count = blocks.groupBy("sk").agg(F.count("*").alias("held"), F.sum(F.col("passes") + F.col("begun").cast("int")).alias("quota"), F.sum(F.col("words") * (F.col("passes") + F.col("whole").cast("int"))).alias("taken"))
        listed = pinned(count.orderBy("sk")).toPandas()  # one row for each source
        listed = listed.sort_values("sk", ignore_index=True)
        shards = int(max(1, listed.taken.sum() // shard_words)) if len(listed) else 1
        held, quotas, number = listed.held.to_numpy(np.int64), listed.quota.to_numpy(np.int64), {k: i for i, k in enumerate(listed.sk)}
        shared = docs.sparkSession.sparkContext.broadcast((held, quotas, number))

        def deal(batches):
            held, quotas, number = shared.value
            for batch in batches:
                source = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
                rank = batch.column(2).to_numpy() * held[source] + batch.column(3).to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shards_of(quotas, shards, seed, source, rank))], names=["sk", "block", "pass", "shard"])

        times = (F.col("passes") + F.col("begun").cast("int")).alias("n")
        draws = blocks.withColumn("n", times).where("n > 0").select("sk", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("pass"), F.col("place").cast("long"))
        dealt = map_arrow(draws, deal, "sk string, block long, pass long, shard long").groupBy("sk", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))  # a block's few passes
        none = F.array().cast("array<struct<pass:bigint,shard:bigint>>")
        self.blocks = pinned(blocks.select("sk", "block", "passes", "before", "whole", "begun").join(dealt, ["sk", "block"], "left").withColumn("dealt", F.coalesce("dealt", none)), outlives=True)
        # of the last block a source begins, a document is taken if at least half of it lies below the target; equal rows go together
        edge = placed.where("size > 0").join(F.broadcast(self.blocks.where("begun and not whole").select("sk", "block", "before")), ["sk", "block"]).groupBy("sk", "block", "id", "th", "rest", "before").agg(F.sum("size").alias("size"))  # one block for each source
        order = Window.partitionBy("sk", "block").orderBy(_mark(seed, "id", "th", F.lit("in")), "id", "th")
        edge = edge.withColumn("at", F.col("before") + before(order, "size")).where(F.col("at") + F.col("size") / 2 <= F.col("rest"))
        self.picked = pinned(edge.select("sk", "id", "th"), outlives=True)

    def placed(self, rows: DataFrame) -> DataFrame:
        aims = self.aims.select("sk", "source_size", "target", "n_blocks", "passes", "rest")
        return rows.join(bounded(aims), "sk").withColumn("block", F.pmod(_mark(self.seed, "id", "th"), F.col("n_blocks")))

    def drawn(self, rows: DataFrame) -> DataFrame:
        """rows(id, sk, th, size, ...) with source_size, target and draws: the (pass, shard) of each time that the row is taken."""
        picked = self.picked.select(F.col("sk").alias("_ps"), F.col("id").alias("_pi"), F.col("th").alias("_pt"))
        got = self.placed(rows).join(bounded(self.blocks.select("sk", "block", "whole", "dealt")), ["sk", "block"])
        got = got.join(bounded(picked), (F.col("sk") == F.col("_ps")) & F.col("id").eqNullSafe(F.col("_pi")) & (F.col("th") == F.col("_pt")), "left")
        full = F.col("passes") + (F.col("whole") | F.col("_ps").isNotNull()).cast("int")
        return got.withColumn("draws", F.when(F.col("size") > 0, F.filter("dealt", lambda d: d["pass"] < full)).otherwise(F.filter("dealt", lambda d: F.lit(False))))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, block_docs: int = BLOCK_DOCS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each row of docs: id, size, source_size, target, taken (words of the draws that the tree dealt, repeats counted) and shards (of those draws)."""
    with scratch(docs.sparkSession):
        plan = Mix(docs, id_col, text_col, source_col, seed, block_docs, shard_words)
        got = plan.drawn(plan.rows)
        return pinned(got.select(F.col("id").alias(id_col), "size", "source_size", F.col("target").cast("double"), (F.col("size") * F.size("draws")).alias("taken"), F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",").alias("shards")), outlives=True)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, block_docs: int = BLOCK_DOCS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mixed documents, each as often as it is drawn, dealt to their shards and shuffled there. The columns stay as they are."""
    spark, whole = docs.sparkSession, unused("row", docs)
    at = lambda c: F.col(f"{whole}.`{c}`")
    rows = docs.select(F.struct(*own(docs)).alias(whole)).select(whole, at(id_col).alias("id"), _key(at(source_col)).alias("sk"), F.xxhash64(at(text_col)).alias("th"), (F.length(at(text_col)) > 0).cast("int").alias("size"))
    with scratch(spark):
        plan = Mix(docs, id_col, text_col, source_col, seed, block_docs, shard_words)
        worded = F.coalesce(at(text_col).rlike(WORD), F.lit(False)).cast("int")
        got = plan.drawn(rows.withColumn("size", worded)).select(whole, "id", "th", F.explode("draws").alias("draw"))
        local = _mark(seed, F.lit("local"), "id", "th", "draw.pass")
        # a shard has a bounded size, whatever the corpus
        dealt = got.withColumn("local", local).repartition("draw.shard", F.pmod("local", F.lit(4))).sortWithinPartitions("draw.shard", "local")
        return pinned(dealt.select(*[at(c.replace("`", "``")).alias(c) for c in docs.columns]), outlives=True)
