"""MinHash near-dedup: ProbMinHash over weighted shingles, banding, verification, components.

A shingle is five words of the lower-cased text (all words of a shorter text), weighted by how often
it stands in the text. For each register the shingle that arrives first is kept, where a shingle of
weight w arrives in a random register at the times of a Poisson process of rate w, all drawn from
hashes of the shingle. A shingle stops once its next arrival is later than all registers of its
text, so long texts need little more than one arrival each. Registers agree with the probability
Jaccard similarity of the texts.

Texts of equal weighted shingles are one class from the start, and one of them stands for all. Bands
of registers are bucketed, and each text is compared with its buckets' heads. What that leaves apart
is compared inside the buckets: in large ones first in rounds, where all texts are dealt at random
into cells and all pairs of a cell are compared, for as long as a round joins many components; then
all buckets that still hold several components are compared in full, dealt in blocks over cells of
two blocks each, where every text meets all texts of other components. So in the end any two texts
of a bucket are of one component or have been compared; there is no limit on partners. A link needs
a similarity (probability Jaccard, or that of the plain shingle sets) of 0.8, computed from the texts.

Defined cases: texts without words are in no class but their own; rows that share an id are one
document, linked by any of their texts; a null id has a null class; very long texts are compared
whole; of tied copies the least id stays; an empty table gives no rows; extra columns are carried by
deduplicated() and ignored by classes(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow, ship
from .common import Words, bounded, components, mix, own, pieces, pinned, scratch, signed, slices, unused

SHINGLE, THRESHOLD = 5, 0.8
#: 16 bands of 4 registers: at similarity 0.8 a pair meets in a bucket with probability 0.9998.
BANDS, ROWS = 16, 4
#: Texts and shingles in a block of a bucket; a cell holds two blocks.
BLOCK, BLOCK_SHINGLES = 256, 100_000
#: Rounds in large buckets go on while one leaves at most this share of the components.
WORTH = 0.8
_GOLD, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def weighted(shingles: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, their text and how often they occur."""
    if not len(shingles):
        return shingles, text_of, np.zeros(0, np.int64)
    order = np.lexsort((shingles, text_of))
    s, t = shingles[order], text_of[order]
    head = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])])
    return s[head], t[head], np.diff(np.r_[head, len(s)])


def probminhash(s: np.ndarray, text: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """(texts, registers): the first shingle to arrive in each register; 0 for texts without shingles."""
    first = np.full(texts * registers, np.inf)
    sig = np.zeros(texts * registers, np.uint64)
    limit = np.full(texts, np.inf)
    at = np.zeros(len(s))
    step = 0
    while len(s):
        step += 1
        shift, salt = (np.uint64(int(x) * step & 0xFFFFFFFFFFFFFFFF) for x in (_GOLD, _SALT))
        u = mix(s + shift)
        at = at - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight
        soon = at < limit[text]
        s, text, weight, at = s[soon], text[soon], weight[soon], at[soon]
        place = text * registers + (mix(s ^ salt) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, place, at)
        won = first[place] == at
        sig[place[won]] = s[won]
        limit = first.reshape(texts, registers).max(axis=1)
    return sig.reshape(texts, registers)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        out = mix(out * _GOLD + sig.reshape(len(sig), bands, rows)[:, :, r])
    return mix(out + np.arange(1, bands + 1, dtype=np.uint64) * _SALT)


def probability_jaccard(a: tuple, b: tuple) -> float:
    """Of two weighted sets (sorted distinct shingles, weights): the sum, over what both hold, of 1 / sum of the larger of the two scaled weights."""
    (sa, wa), (sb, wb) = a, b
    both, ia, ib = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    union = np.union1d(sa, sb)
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, sa)], y[np.searchsorted(union, sb)] = wa, wb
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    y_upto = np.cumsum(y)  # where the ratio is no larger, b's scaled weight is the larger one
    x_after = x.sum() - np.cumsum(x)
    r = wa[ia] / wb[ib]
    last = np.searchsorted(ratio, r, side="right") - 1
    return float((1.0 / (x_after[last] / wa[ia] + y_upto[last] / wb[ib])).sum())


def similarity(a: tuple, b: tuple, weighted_too: bool = True) -> float:
    shared = len(np.intersect1d(a[0], b[0], assume_unique=True))
    plain = shared / max(1, len(a[0]) + len(b[0]) - shared)
    # unweighted sets need no second look; probability Jaccard is that of the sets
    return plain if not weighted_too or plain >= THRESHOLD or not shared or (a[1].max() == 1 and b[1].max() == 1) else max(plain, probability_jaccard(a, b))


def signatures(docs: DataFrame) -> DataFrame:
    """(id, k1, k2, size, bands) of docs(id, text) with words: k1, k2 stand for the weighted shingles, size is how many differ."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, (1,)):
                w = Words([(t or "").lower() for t in part.column(1).to_pylist()])
                s, t, n = weighted(*w.shingles(SHINGLE))
                has = np.flatnonzero(np.bincount(t, minlength=part.num_rows)) if len(s) else np.zeros(0, np.int64)
                if not len(has):
                    continue
                starts = np.searchsorted(t, has)
                m = n.astype(np.uint64)
                keys = [np.add.reduceat(mix(s ^ x) * m, starts) for x in (_GOLD, _SALT)]
                bands = band_hashes(probminhash(s, np.searchsorted(has, t), n.astype(np.float64), len(has), BANDS * ROWS), BANDS, ROWS)
                flat = pa.array(signed(bands.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), flat)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(has)), *[pa.array(signed(k)) for k in keys], pa.array(np.diff(np.r_[starts, len(s)]).astype(np.int64)), lists], names=["id", "k1", "k2", "size", "bands"])

    return map_arrow(docs, run, f"id {dict(docs.dtypes)['id']}, k1 long, k2 long, size long, bands array<long>")


def verified(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], weighted_too: bool = True) -> DataFrame:
    """Those of pairs(a, b) whose texts are similar, as links(a, b). texts gives (id, text) for a table of ids."""
    spark, kind = pairs.sparkSession, dict(pairs.dtypes)["a"]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, (2, 3)):
                left, right = ([(t or "").lower() for t in part.column(i).to_pylist()] for i in (2, 3))
                distinct = sorted(set(left) | set(right))
                s, t, n = weighted(*Words(distinct).shingles(SHINGLE))
                ends = np.searchsorted(t, np.arange(len(distinct) + 1))
                sets = {x: (s[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]].astype(np.float64)) for i, x in enumerate(distinct)}
                good = [i for i in range(part.num_rows) if similarity(sets[left[i]], sets[right[i]], weighted_too) >= THRESHOLD]
                yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(good, pa.int64())) for k in (0, 1)], names=["a", "b"])

    with scratch(spark):
        pairs = pinned(pairs)
        held = texts(bounded(pinned(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())))
        both = pairs.join(held.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(held.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
        return pinned(map_arrow(both, run, f"a {kind}, b {kind}").distinct(), outlives=True)


def compared(dealt: DataFrame, texts: Callable[[DataFrame], DataFrame], weighted_too: bool = True) -> DataFrame:
    """links(a, b): in each cell of dealt(cell, id, root), enough for the components of all similar texts of different roots."""
    kind = dict(dealt.dtypes)["id"]

    def run(group: pa.Table) -> pa.Table:
        pairs = joined([(t or "").lower() for t in group.column("text").to_pylist()], group.column("root").to_pylist(), weighted_too)
        ids = group.column("id")
        return pa.table({k: ids.take(pa.array([p[i] for p in pairs], pa.int64())) for i, k in enumerate(("a", "b"))})

    ship(dealt.sparkSession)
    with scratch(dealt.sparkSession):
        dealt = pinned(dealt)
        held = texts(bounded(pinned(dealt.select("id").distinct())))
        return pinned(dealt.join(held, "id").select("cell", "id", "root", "text").groupBy("cell").applyInArrow(run, f"a {kind}, b {kind}").distinct(), outlives=True)


def linked(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], weighted_too: bool = True) -> DataFrame:
    """links(a, b) between nodes(id, size, bands) that are similar: enough for the same components as all links that meet in a bucket."""
    with scratch(nodes.sparkSession):
        spread = nodes.select("id", "size", F.explode("bands").alias("bucket"))
        heads = spread.groupBy("bucket").agg(F.min("id").alias("head"), F.count("*").alias("n"), F.sum("size").alias("sizes")).where("n > 1")
        members = pinned(spread.join(heads, "bucket"))
        links = verified(members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), texts, weighted_too)
        large, roots = members.where((F.col("n") > 2 * BLOCK) | (F.col("sizes") > 2 * BLOCK_SHINGLES)), None
        if large.limit(1).count():
            links, roots = settled(large, links, texts, weighted_too)
        more = compared(cells(members, components(links) if roots is None else roots), texts, weighted_too)
        return pinned(links.unionByName(more), outlives=True)


def mixed(at: DataFrame) -> DataFrame:
    """The rows of at(bucket, root, ...) of those buckets that hold several roots."""
    at = pinned(at)
    several = at.groupBy("bucket").agg((F.min("root") < F.max("root")).alias("several")).where("several").select("bucket")
    return at.join(bounded(pinned(several)), "bucket")


def named(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members with the root of each one's component, of those buckets that hold several components."""
    return mixed(members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))


def settled(large: DataFrame, links: DataFrame, texts: Callable[[DataFrame], DataFrame], weighted_too: bool) -> tuple[DataFrame, DataFrame]:
    """links(a, b) with those found in random cells of large buckets, round by round, while a round joins many components; and their components."""
    # at first a bucket's texts are of its head's component if they are linked to it, else of their own
    linked_to = links.select(F.col("a").alias("head"), F.col("b").alias("id"), F.lit(True).alias("near"))
    at = mixed(large.join(linked_to, ["head", "id"], "left").withColumn("root", F.when(F.col("near") | (F.col("id") == F.col("head")), F.col("head")).otherwise(F.col("id"))))
    before, turn = at.select("root").distinct().count(), 0
    roots = None if before else components(links)
    while before:
        turn += 1
        many = F.greatest(F.col("n") / (2 * BLOCK), F.col("sizes") / (2 * BLOCK_SHINGLES))
        dealt = at.select(F.xxhash64("bucket", F.pmod(F.xxhash64(F.lit(turn), "id", "bucket"), F.ceil(many).cast("long"))).alias("cell"), "id", "root")
        links = links.unionByName(compared(dealt, texts, weighted_too))
        roots = components(links)
        at = named(large, roots)
        left = at.select("root").distinct().count()
        before = left if left <= WORTH * before else 0
    return links, roots


def cells(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(cell, id, root): the members(bucket, id, size) of buckets with several components, dealt so that any two of one bucket and different roots share a cell."""
    at = named(members.select("bucket", "id", "size"), roots)
    # buckets of the same members are compared once
    sums = at.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    once = pinned(sums.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"))
    at = at.join(bounded(once), "bucket", "left_semi")
    # a component of a block or more has blocks of its own, which need not meet one another
    blocks_of = lambda n, s: F.greatest(F.lit(1), F.ceil(F.greatest(F.col(n) / BLOCK, F.col(s) / BLOCK_SHINGLES))).cast("long")
    per = pinned(at.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("size").alias("s")).withColumn("k", blocks_of("c", "s")))
    small = lambda x: F.sum(F.when(F.col("k") < 2, F.col(x)).otherwise(0))
    whole = per.groupBy("bucket").agg(F.sum("c").alias("n"), F.sum("s").alias("ns"), small("c").alias("rc"), small("s").alias("rs")).withColumns({"large": blocks_of("n", "ns") > 2, "rest": blocks_of("rc", "rs")})
    dealt = per.join(whole, "bucket").select("bucket", "root", F.when(F.col("large") & (F.col("k") > 1), F.col("root")).alias("owner"), F.when(~F.col("large"), F.lit(1)).when(F.col("k") > 1, F.col("k")).otherwise(F.col("rest")).alias("parts"))
    at = at.join(dealt, ["bucket", "root"])
    at = pinned(at.select("bucket", "id", "root", "owner", F.xxhash64("owner", F.pmod(F.xxhash64("id"), "parts")).alias("block")))
    blocks = pinned(at.select("bucket", "owner", "block").distinct())
    pairs = blocks.select("bucket", F.col("owner").alias("o"), F.col("block").alias("a")).join(blocks.select("bucket", "owner", F.col("block").alias("b")), "bucket").where("a < b and (o <=> owner and o is null or not (o <=> owner))").select("bucket", "a", "b")
    alone = blocks.groupBy("bucket").agg(F.count("*").alias("k"), F.min("block").alias("a")).where("k = 1").select("bucket", "a", F.col("a").alias("b"))
    met = pairs.unionByName(alone).select("bucket", F.xxhash64("bucket", "a", "b").alias("cell"), F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    return at.join(met, ["bucket", "block"]).select("cell", "id", "root")


def joined(texts: list[str], roots: list, weighted_too: bool = True) -> list[tuple[int, int]]:
    """Pairs of similar texts of different roots: enough for the components of all such pairs."""
    parts = [weighted(*Words(texts[i:j]).shingles(SHINGLE)) for i, j in slices(texts)]
    per = [np.bincount(t, minlength=j - i) for (i, j), (_, t, _) in zip(slices(texts), parts, strict=True)]
    size = np.concatenate(per)
    held = np.flatnonzero(size)
    if not len(held):
        return []
    s, n = np.concatenate([x[0] for x in parts]), np.concatenate([x[2] for x in parts]).astype(np.float64)
    size = size[held]
    ends = np.cumsum(size)
    starts = ends - size
    distinct, code = np.unique(s, return_inverse=True)
    share = n / np.repeat(np.add.reduceat(n, starts), size)
    repeats = np.maximum.reduceat(n, starts) > 1
    names = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    comp = np.array([names[roots[i]] for i in held])
    most = np.bincount(comp).argmax()
    out = []
    mine = np.zeros(len(distinct))
    # each text but those of the largest component meets all texts of other components
    for x in np.flatnonzero(comp != most):
        other = comp != comp[x]
        if not other.any():
            continue
        span = slice(starts[x], ends[x])
        mine[code[span]] = share[span]
        there = mine[code]
        shared = np.add.reduceat((there > 0).astype(np.int64), starts)
        near = other & (shared / (size + size[x] - shared) >= THRESHOLD)
        maybe = other & ~near & (shared > 0) & (repeats | repeats[x])
        if not weighted_too:
            maybe[:] = False
        if maybe.any():
            # probability Jaccard is at most the sum of the lesser shares
            maybe &= np.add.reduceat(np.minimum(there, share), starts) >= THRESHOLD - 1e-9
        mine[code[span]] = 0
        for y in np.r_[np.flatnonzero(near), np.flatnonzero(maybe)]:
            if comp[y] != comp[x] and (near[y] or probability_jaccard(*((s[starts[z] : ends[z]], n[starts[z] : ends[z]]) for z in (x, y))) >= THRESHOLD):
                out.append((int(held[x]), int(held[y])))
                comp[comp == comp[y]] = comp[x]
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, is_kept) of every row of docs: class_id is the least id of the near copies, which is the one to keep."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession):
        sigs = pinned(signatures(rows)).where("id is not null")
        distinct = pinned(sigs.groupBy("k1", "k2").agg(F.min_by(F.struct("size", "bands"), "id").alias("at"), F.min("id").alias("rep"), F.max("id").alias("last")).select("k1", "k2", "at.size", "at.bands", "rep", "last"))
        shared = distinct.where("rep <> last").select("k1", "k2", "rep")
        copies = sigs.select("id", "k1", "k2").join(bounded(pinned(shared)), ["k1", "k2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
        links = linked(distinct.select(F.col("rep").alias("id"), "size", "bands"), lambda need: rows.where("id is not null").join(need, "id", "left_semi")).unionByName(copies)
        roots = pinned(components(links).select(F.col("node").alias("id"), F.col("root")), outlives=True)
    return rows.select("id").join(roots, "id", "left").select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("class_id"), F.coalesce(F.col("root") == F.col("id"), F.lit(True)).alias("is_kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, in docs' own columns. Of rows that share an id one stays; rows with a null id all stay."""
    gone, again, key = unused("gone", docs), unused("again", docs), F.col(f"`{id_col}`")
    with scratch(docs.sparkSession):
        out = pinned(classes(docs, id_col, text_col).where("not is_kept").select(F.col(id_col).alias(gone)).distinct(), outlives=True)
        left = docs.join(bounded(out), key == F.col(gone), "left_anti")
        twice = pinned(left.where(key.isNotNull()).groupBy(key.alias(again)).agg(F.count("*").alias("n")).where("n > 1").select(again), outlives=True)
    if not twice.limit(1).count():
        return left
    pick = left.join(bounded(twice), key == F.col(again), "left_semi").dropDuplicates([id_col])
    return left.join(bounded(twice), key == F.col(again), "left_anti").unionByName(pick).select(*own(docs))
