"""Substring dedup: passages that repeat across documents, found by MinHash banding of paragraphs.

A paragraph is a line of at least LEAST_PARAGRAPH words. Exactly equal paragraphs (words compared
lower-cased) are one from the start. The others are banded by MinHash over five-word shingles, with
the fewest bands that reach the recall asked for; colliding paragraphs are joined, verified by exact
Jaccard similarity, and clustered by components. A cluster is reported if it spans documents and one
of its paragraphs has LEAST_WORDS words; the first one (least document, then place) stays and all
others are to be removed. These rows have kind "paragraph".

An addition finds passages inside paragraphs, or across lines, that repeat word for word (kind
"window"): windows of RUN words that begin at words selected by content (those of least hash among
any RUN neighbours), so that LEAST_WORDS equal words always hold an equal window. Windows that
several documents hold, and that lie in no reported paragraph, are joined where they overlap and
extended on both sides, word by word, as far as the text equals that around the same window in
another document; a span of LEAST_WORDS words is reported.

Defined cases: a null or empty text has no passages; rows that share an id are one document, but
their passages are never joined by position; rows with a null id are documents of their own, last in
order, and rows that repeat whole are one; of ties the least row by id, then by content, stays;
passages that repeat inside one document alone are left alone; very long texts are read whole; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import WORD, Words, bounded, components, mix, pieces, pinned, run_hashes, scratch, signed
from .neardup import SHINGLE, THRESHOLD, band_hashes, linked

#: Words of a passage that is reported, and of a paragraph that is compared.
LEAST_WORDS, LEAST_PARAGRAPH = 50, 40
#: Words of a window, and neighbours among which one begins.
RUN = 25
#: Minima of a paragraph, and the least probability that two paragraphs at the threshold meet in a band.
MINIMA, RECALL = 16, 0.999


def tuned(minima: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bands, rows): the longest bands, and so the fewest needless collisions, that reach the recall at the threshold; single minima if none do."""
    reach = lambda r: 1 - (1 - threshold**r) ** (minima // r)
    rows = max((r for r in range(1, minima + 1) if reach(r) >= recall), default=1)
    return minima // rows, rows


BANDS, ROWS = tuned(MINIMA, THRESHOLD, RECALL)
_ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def minhash(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, BANDS * ROWS) minima of multiplied and shifted hashes over runs of s that begin at starts."""
    out = np.empty((len(starts), len(_ODD)), np.uint64)
    for k, odd in enumerate(_ODD):
        x = s * odd
        x ^= x >> np.uint64(29)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rid, text): rid stands for the row's content."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.select("id", F.xxhash64("id", "text").alias("rid"), "text")


def document() -> Column:
    """A number for the document of a row: that of its id, or of its content if it has none."""
    return F.when(F.col("id").isNull(), F.col("rid")).otherwise(F.xxhash64("id"))


def paragraphs(rows: DataFrame) -> DataFrame:
    """(id, rid, start, end, words, key, size, bands) of each paragraph of rows(id, rid, text); start and end in code points, key stands for its words."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, (2,)):
                lines, row, start, end = [], [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    at = 0
                    for line in (text or "").split("\n"):
                        if len(line) >= 2 * LEAST_PARAGRAPH - 1:
                            lines.append(line.lower())
                            row.append(i)
                            start.append(at)
                            end.append(at + len(line))
                        at += len(line) + 1
                w = Words(lines)
                long = np.flatnonzero(w.count >= LEAST_PARAGRAPH)
                if not len(long):
                    continue
                s, t = w.shingles(SHINGLE)
                mine = np.isin(t, long)
                s, t = s[mine], t[mine]
                starts = np.searchsorted(t, long)
                words = np.repeat(np.arange(len(lines)), w.count)
                order = (np.arange(len(w.hash)) - w.first[:-1][words]).astype(np.uint64)
                sums = [np.r_[np.uint64(0), np.cumsum(mix(w.hash ^ mix(order + np.uint64(x))))] for x in (11, 13)]
                keys = [c[w.first[long + 1]] - c[w.first[long]] for c in sums]
                both = np.ascontiguousarray(np.stack(keys, axis=1).astype(">u8")).tobytes()
                named = [both[i : i + 16] for i in range(0, len(both), 16)]
                bands = band_hashes(minhash(s, starts), BANDS, ROWS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(long) + 1, dtype=np.int32) * BANDS), pa.array(signed(bands.ravel())))
                pick = lambda x: np.array(x, np.int64)[long]  # noqa: E731,B023
                of = pa.array(pick(row))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(of), part.column(1).take(of), pa.array(pick(start)), pa.array(pick(end)), pa.array(w.count[long]), pa.array(named, pa.binary()), pa.array(np.diff(np.r_[starts, len(s)]).astype(np.int64)), lists],
                    names=["id", "rid", "start", "end", "words", "key", "size", "bands"],
                )

    return map_arrow(rows, run, f"id {dict(rows.dtypes)['id']}, rid long, start long, end long, words long, key binary, size long, bands array<long>")


def near_paragraphs(rows: DataFrame) -> DataFrame:
    """(id, rid, start, end, n_words, class_id, first_id, removed): the paragraphs of the clusters that are reported."""
    with scratch(rows.sparkSession):
        found = pinned(paragraphs(rows))
        place = F.struct(F.col("id").isNull().alias("n"), "id", "rid", "start", "end")
        distinct = pinned(found.groupBy("key").agg(F.min(place).alias("at"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.count("*").alias("copies")))
        places = distinct.select("key", F.col("at.id").alias("id"), F.col("at.rid").alias("rid"), F.col("at.start").alias("start"), F.col("at.end").alias("end"))
        links = linked(distinct.select(F.col("key").alias("id"), "size", "bands"), lambda need: passages(need, places, rows), weighted_too=False)
        roots = components(links).select(F.col("node").alias("key"), "root")
        classes = distinct.select("key", "copies").join(roots, "key", "left").where("copies > 1 or root is not null").select("key", F.coalesce("root", "key").alias("class_key"))
        hits = pinned(found.drop("bands", "size").join(bounded(pinned(classes)), "key").drop("key"))
        spans = hits.groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "rid", "start")).alias("f"), F.min(document()).alias("d"), F.max(document()).alias("e"), F.max("words").alias("w")).where(f"d <> e and w >= {LEAST_WORDS}").drop("d", "e", "w")
        first = (F.col("rid") == F.col("f.rid")) & (F.col("start") == F.col("f.start")) & F.col("id").eqNullSafe(F.col("f.id"))
        out = hits.join(bounded(pinned(spans)), "class_key").select("id", "rid", "start", "end", F.col("words").alias("n_words"), F.lower(F.hex("class_key")).alias("class_id"), F.col("f.id").alias("first_id"), (~first).alias("removed"))
        return pinned(out.distinct(), outlives=True)


def passages(need: DataFrame, places: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, text) of the paragraphs whose keys need(id) lists."""
    at = pinned(places.join(need.select(F.col("id").alias("key")), "key", "left_semi").select("key", "rid", "start", "end"))
    cut = F.substring("text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return rows.select("rid", "text").join(bounded(at), "rid").select(F.col("key").alias("id"), cut.alias("text"))


def least_of(h: np.ndarray, n: int, least: np.ufunc) -> np.ndarray:
    """At each place the least (or, by np.maximum, largest) of the n values from it on; shorter by n - 1."""
    out, width = h, 1
    while width < n:
        step = min(width, n - width)
        out = least(out[:-step], out[step:])
        width += step
    return out


def begins(w: Words) -> np.ndarray:
    """Words at which a window begins: whose following three words hash least among some RUN neighbours of their text; RUN words follow."""
    n = len(w.hash)
    if n < 2 * RUN:
        return np.zeros(0, np.int64)
    three = mix(mix(w.hash[:-2] + np.uint64(1)) + np.roll(w.hash, -1)[:-2] * np.uint64(3) + np.roll(w.hash, -2)[:-2]) | np.uint64(1)
    low = least_of(three, RUN, np.minimum)
    at = np.arange(len(low))
    # a window of neighbours lies in one text, with the words that follow
    low[w.text_of[at] != w.text_of[np.minimum(at + 2 * RUN - 2, n - 1)]] = 0
    low[at + 2 * RUN - 2 >= n] = 0
    padded = np.r_[np.zeros(RUN - 1, np.uint64), low, np.zeros(RUN - 1, np.uint64)]
    return np.flatnonzero(least_of(padded, RUN, np.maximum)[: len(three)] == three)


def windows(rows: DataFrame) -> DataFrame:
    """(id, rid, at, start, end, k1, k2): the windows of rows(id, rid, text), from word `at`, start and end in code points; k1, k2 stand for the words."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, (2,)):
                w = Words([t or "" for t in part.column(2).to_pylist()], ascii_lower=True)
                start = begins(w)
                if not len(start):
                    continue
                end, of = start + RUN, w.text_of[start]
                points = np.r_[0, np.cumsum((w.data & 0xC0) != 0x80)]
                base, row = points[w.text_start][of], pa.array(of)
                keys = [run_hashes(mix(w.hash ^ np.uint64(x)), start, end) for x in (3, 5)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(start - w.first[of]), pa.array(points[w.start[start]] - base), pa.array(points[w.end[end - 1]] - base), *[pa.array(signed(k)) for k in keys]], names=["id", "rid", "at", "start", "end", "k1", "k2"])

    return map_arrow(rows, run, f"id {dict(rows.dtypes)['id']}, rid long, at long, start long, end long, k1 long, k2 long")


_WORD = re.compile(WORD)


def common_words(mine: str, other: str) -> tuple[int, int]:
    """How many words from the front both have in common, and where the last of them ends in mine."""
    n = end = 0
    for a, b in zip(_WORD.finditer(mine), _WORD.finditer(other)):
        if a[0].lower() != b[0].lower():
            break
        n, end = n + 1, a.end()
    return n, end


def words_from(text: Column, pos: Column, left: Column, reach: int = 2_000) -> Column:
    """The first RUN words after a place of a text, or of its reverse before it; read from so many characters if they hold the words, else from all."""
    ahead = rf"^(?:[\x20\x09-\x0D]*{WORD}){{0,{RUN}}}"
    part = lambda n: F.when(left, F.reverse(text.substr(F.greatest(pos - n + 1, F.lit(1)), F.least(n, pos)))).otherwise(text.substr(pos + 1, n))
    near, whole = part(F.lit(reach)), F.regexp_extract(part(F.length(text)), ahead, 0)
    got = F.regexp_extract(near, ahead, 0)
    # words stand behind those that were read, or nothing at all
    enough = (F.length(near) < reach) | near.substr(F.length(got) + 1, F.lit(reach)).rlike(rf"^[\x20\x09-\x0D]+{WORD}")
    return F.when(enough, got).otherwise(whole)


def extended(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """spans with start, end and n_words moved out over the words that stand alike around `there`, the edge in another text."""
    sides = spans.select("rid", "own", "span", F.explode(F.array(F.struct(F.lit(True).alias("left"), F.col("start").alias("pos"), F.col("head.r").alias("r"), F.col("head.s").alias("p")), F.struct(F.lit(False).alias("left"), F.col("end").alias("pos"), F.col("tail.r").alias("r"), F.col("tail.e").alias("p")))).alias("x")).select("rid", "own", "span", "x.*")
    sides = pinned(sides)
    asked = sides.select("rid", "pos", "left").union(sides.select("r", "p", "left")).groupBy("rid").agg(F.collect_set(F.struct("pos", "left")).alias("asked"))  # a text's own edges
    # each asked text crosses the shuffle once, at any size, with all its edges
    texts = rows.select("rid", "text").hint("shuffle_hash").join(asked.hint("shuffle_hash"), "rid")
    seen = pinned(texts.select("rid", "text", F.explode("asked").alias("x")).select("rid", "x.pos", "x.left", words_from(F.col("text"), F.col("x.pos").cast("int"), F.col("x.left")).alias("words")).dropDuplicates(["rid", "pos", "left"]))
    both = sides.join(seen.withColumnRenamed("words", "mine"), ["rid", "pos", "left"]).join(seen.select(F.col("rid").alias("r"), F.col("pos").alias("p"), "left", F.col("words").alias("other")), ["r", "p", "left"])

    def run(batches):
        for batch in batches:
            got = [common_words(a, b) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], names=["rid", "own", "span", "left", "n", "chars"])

    more = map_arrow(both.select("rid", "own", "span", "left", "mine", "other"), run, "rid long, own boolean, span long, left boolean, n long, chars long")
    of = lambda c, side: F.sum(F.when(F.col("left") == side, F.col(c)).otherwise(0))
    more = more.groupBy("rid", "own", "span").agg(F.sum("n").alias("add"), of("chars", True).alias("before"), of("chars", False).alias("after"))
    return spans.join(more, ["rid", "own", "span"]).withColumns({"start": F.col("start") - F.col("before"), "end": F.col("end") + F.col("after"), "n_words": F.col("n_words") + F.col("add")})


def repeated_windows(rows: DataFrame, reported: DataFrame) -> DataFrame:
    """(id, rid, start, end, n_words, class_id, first_id, removed): spans of windows that several documents hold and that lie in none of the spans reported(rid, start, end)."""
    with scratch(rows.sparkSession):
        held = lambda df, *k: df.groupBy(*k).agg(F.min(document()).alias("d"), F.max(document()).alias("e")).where("d <> e").select(*k)
        # one half of the key finds candidates, for the narrower shuffle; both halves decide among the few that are left
        near = pinned(windows(rows).join(bounded(pinned(held(windows(rows), "k1"))), "k1", "left_semi"))
        place = F.struct(F.col("id").isNull().alias("n"), "id", F.col("rid").alias("r"), "at", F.col("start").alias("s"), F.col("end").alias("e"))
        classes = near.groupBy("k1", "k2").agg(F.min(place).alias("f"), F.max(place).alias("l"), F.min(document()).alias("d"), F.max(document()).alias("e")).where("d <> e").drop("d", "e")
        hits = near.join(bounded(pinned(classes)), ["k1", "k2"])
        own = (F.col("rid") == F.col("f.r")) & F.col("id").eqNullSafe(F.col("f.id"))
        hits = hits.select("id", "rid", "at", "start", "end", "f", own.alias("own"), F.when(own, F.col("l")).otherwise(F.col("f")).alias("there"), F.concat(F.lower(F.hex("k1")), F.lower(F.hex("k2"))).alias("class_id"))
        spans = reported.select("rid", "start", "end").distinct().groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # a document's own
        hits = hits.join(spans, "rid", "left").where(~F.coalesce(F.exists("spans", lambda s: (s["start"] <= F.col("start")) & (s["end"] >= F.col("end"))), F.lit(False))).drop("spans")
        order = Window.partitionBy("rid", "own").orderBy("at")
        new = F.coalesce(F.col("at") > F.lag("at").over(order) + RUN, F.lit(True)).cast("long")
        hits = hits.withColumn("new", new).withColumn("span", F.sum("new").over(order))
        spans = pinned(hits.groupBy("rid", "own", "span").agg(F.min("id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"), (F.max("at") + RUN - F.min("at")).alias("n_words"), F.min_by("there", "at").alias("head"), F.max_by("there", "at").alias("tail"), F.min("class_id").alias("class_id"), F.min_by("f", "at").alias("f")))
        out = extended(spans, rows).where(F.col("n_words") >= LEAST_WORDS)
        return pinned(out.select("id", "rid", "start", "end", "n_words", "class_id", F.col("f.id").alias("first_id"), (~F.col("own")).alias("removed")), outlives=True)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, n_words, class_id, first_id, removed, kind) of each passage that is reported; start and end in code points."""
    rows = identified(docs, id_col, text_col)
    with scratch(docs.sparkSession):
        near = near_paragraphs(rows)
        more = repeated_windows(rows, near)
        out = near.withColumn("kind", F.lit("paragraph")).unionByName(more.withColumn("kind", F.lit("window")))
        return pinned(out.drop("rid").withColumnRenamed("id", id_col), outlives=True)
