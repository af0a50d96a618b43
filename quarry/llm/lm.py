"""Language-model scoring: exact word counts of the training documents and a gated recurrent model.

Spark counts every training word. The commonest words are the recurrent model's own; any rarer word
is of one of gru.RARE kinds by its last two bytes, which the model reads and predicts as a word,
followed by the add-one frequency of that word among those of its kind. The recurrent model reads
every training document once, in rounds: in each, every task trains a copy on its share by truncated
backpropagation, and the copies' average, weighted by words, opens the next round. So the score
depends on how the input is dealt to tasks; the counts and the base score do not.

Words are known by 64 bits: 56 of a hash and the kind. Counts of the commonest HELD_WORDS words go to every task; a
document's rarer words meet their counts in a join. Defined cases: a null or empty text is one end
token; a null id is in training; repeated rows score the same each; no training rows: every count is 0; a very long text is scored whole, its state
carried from window to window; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import gru
from .common import BROADCAST_ROWS, Words, held_out, mix, pieces, pinned, signed, slices
from .ngrams import lookup, summed

KINDS = np.uint64(gru.RARE - 1)
END = np.uint64(0xE5D0E5D0E5D0E5D1)
HELD_WORDS, ROUNDS, FAN_IN = BROADCAST_ROWS // 3, 3, 16
#: Characters that a task turns into arrays at a time, and that the model reads side by side.
READ_CHARS, LANE_CHARS = 1_000_000, 12_000_000


def keys_of(w: Words) -> np.ndarray:
    """Hashes of the words, with the kind by the last two bytes in the last bits."""
    last = w.data[w.end - 1].astype(np.uint64) * np.uint64(256) + np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    return (w.hash & ~KINDS) | (mix(last + np.uint64(1)) & KINDS)


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) of train(text): hashes of words, and END once for each document; each task adds up its own first."""

    def run(batches):
        parts, docs = [], 0
        for batch in batches:
            docs += batch.num_rows
            for part in pieces(batch, (0,)):
                h = keys_of(Words([t or "" for t in part.column(0).to_pylist()], ascii_lower=True))
                parts.append(summed(h, np.ones(len(h))))
                if len(parts) > 12:
                    parts = [summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))]
        parts.append((np.array([END]), np.array([docs])))
        k, c = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        for i in range(0, len(k), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(signed(k[i : i + 200_000])), pa.array(c[i : i + 200_000])], names=["word", "n"])

    return map_arrow(train.select("text"), run, "word long, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


class Counts:
    """Sums over all counts, the counts of the commonest words, and the recurrent model's words."""

    def __init__(self, counts: DataFrame, held: int = HELD_WORDS):
        end = int(END.astype(np.int64))
        got = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == end, F.col("n"))).alias("e")).first()
        self.tokens, self.distinct, self.docs = int(got["n"] or 0), int(got["v"]), int(got["e"] or 0)
        # the least count of which no more than `held` words have as much; the counts' own frequencies are few
        self.cut = 1
        if self.distinct > held:
            left = self.distinct
            for row in counts.groupBy("n").agg(F.count("*").alias("w")).orderBy("n").toLocalIterator():
                if left <= held:
                    break
                left -= row["w"]
                self.cut = row["n"] + 1
        t = counts.where((F.col("n") >= self.cut) & (F.col("word") != end)).toArrow()
        words, n = t.column("word").to_numpy().view(np.uint64), t.column("n").to_numpy()
        order = np.argsort(words)
        self.words, self.n = words[order].copy(), n[order].copy()
        top = np.lexsort((self.words, -self.n))[: gru.WORDS - 1 - gru.RARE]
        number = (1 + (self.words & KINDS)).astype(np.int16)
        number[top] = np.arange(1 + gru.RARE, 1 + gru.RARE + len(top))
        self.number = number
        kind = F.col("word").bitwiseAND(int(KINDS))
        sums = counts.where(F.col("word") != end).groupBy(kind.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # one row for each kind
        self.rare_tokens, self.rare_distinct = np.zeros(gru.RARE), np.zeros(gru.RARE)
        for r in sums:
            self.rare_tokens[r["k"]], self.rare_distinct[r["k"]] = r["n"], r["v"]
        own = (self.words[top] & KINDS).astype(np.int64)
        self.rare_tokens -= np.bincount(own, weights=self.n[top], minlength=gru.RARE)
        self.rare_distinct -= np.bincount(own, minlength=gru.RARE)
        common = np.zeros(gru.WORDS)
        common[0], common[1 : 1 + gru.RARE] = self.docs, self.rare_tokens
        common[1 + gru.RARE : 1 + gru.RARE + len(top)] = self.n[top]
        self.common = common

    def read(self, texts: list[str]):
        """For each slice of the texts: its words' numbers, and of its documents the words and of what is not held."""
        for a, b in slices(texts, READ_CHARS):
            w = Words(texts[a:b], ascii_lower=True)
            u, at = np.unique(keys_of(w), return_inverse=True)
            place, hit = lookup(self.words, u)
            number, n = (1 + (u & KINDS)).astype(np.int16), np.zeros(len(u), np.int64)
            number[hit], n[hit] = self.number[place[hit]], self.n[place[hit]]
            yield w, u, at, hit, number, n

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words' numbers with an end after each document, and where documents begin."""
        parts, sizes = [np.zeros(0, np.int16)], [np.zeros(0, np.int64)]
        for w, _, at, _, number, _ in self.read(texts):
            parts.append(number[at])
            sizes.append(w.count)
        return with_ends(np.concatenate(parts), np.concatenate(sizes))


def with_ends(number: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.r_[0, np.cumsum(size + 1)]
    out = np.zeros(int(first[-1]), np.int16)
    at = np.ones(len(out), bool)
    at[first[1:] - 1] = False
    out[at] = number
    return out, first


def fit(train: DataFrame, counts: Counts, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters after the rounds. train(doc_id, text) is read once for each round, a share of the documents in each."""
    sc = train.sparkSession.sparkContext
    params = gru.start(counts.common)
    shared = sc.broadcast(counts)
    for k in range(rounds):
        opened = sc.broadcast(params)

        def run(batches, opened=opened):
            c, p, adam, seen = shared.value, {x: y.copy() for x, y in opened.value.items()}, None, 0
            for batch in batches:
                for part in pieces(batch, (0,), LANE_CHARS):
                    tokens, first = c.numbers([t or "" for t in part.column(0).to_pylist()])
                    # few documents: fewer lanes, so that there are steps to learn from
                    adam = gru.train(p, tokens, first, 0, lanes=int(np.clip(len(tokens) // (gru.WINDOW * 100), 16, 256)), adam=adam)
                    seen += len(tokens)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen % 9973], pa.int32()), pa.array([float(seen)]), pa.array([(gru.flat(p).astype(np.float64) * seen).tobytes()], pa.binary())], names=["part", "weight", "sums"])

        def add(batches):
            weight, sums = 0.0, None
            for batch in batches:
                for w, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    x = np.frombuffer(s)
                    weight, sums = weight + w, x.copy() if sums is None else sums + x
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([weight]), pa.array([sums.tobytes()], pa.binary())], names=["part", "weight", "sums"])

        share = train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == k).select("text")
        schema = "part int, weight double, sums binary"
        copies = map_arrow(share, run, schema)
        # a bounded number of partial sums reaches the driver, however many tasks there are
        rows = map_arrow(copies.repartition(FAN_IN, "part", "weight"), add, schema).collect()
        total = sum(r["weight"] for r in sorted(rows, key=lambda r: (r["weight"], bytes(r["sums"][:64]))))
        if total:
            params = gru.unflat(sum(np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: (r["weight"], bytes(r["sums"][:64])))) / total, params)
        opened.unpersist()
    return params


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, rest: int = 2, held: int = HELD_WORDS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row. Extra columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col), mod, rest).alias("held_out"))
    kind = dict(rows.dtypes)["doc_id"]
    train = rows.where(~F.col("held_out"))
    table = pinned(word_counts(train))
    counts = Counts(table, held)
    params = fit(train, counts)
    sc = docs.sparkSession.sparkContext
    shared, model = sc.broadcast(counts), sc.broadcast(params)
    end_count = counts.docs

    def run(batches):
        c, p = shared.value, model.value
        base_norm = np.log10(c.tokens + 1.0 * (c.distinct + 1))
        rare_norm = np.log10(c.rare_tokens + c.rare_distinct + 1.0)
        for batch in batches:
            for part in pieces(batch, (1,), LANE_CHARS):
                texts = [t or "" for t in part.column(1).to_pylist()]
                numbers, sizes, known, base, rare, tails, ends = [], [], [], [], [], [], [np.zeros(1, np.int64)]
                for w, u, at, hit, number, n in c.read(texts):
                    docs = len(w.count)
                    lg = np.log10(n + 1.0)
                    sums = lambda x: np.bincount(w.text_of, weights=x[at], minlength=docs)  # noqa: E731,B023
                    numbers.append(number[at])
                    sizes.append(w.count)
                    known.append(sums(hit & (n > 0)))
                    base.append(sums(lg))
                    rare.append(sums(np.where(number <= gru.RARE, lg - rare_norm[(u & KINDS).astype(np.int64)], 0.0)))
                    tail = np.flatnonzero(~hit[at]) if c.cut > 1 else np.zeros(0, np.int64)
                    tails.append(u[at[tail]])
                    ends.append(ends[-1][-1] + np.searchsorted(w.text_of[tail], np.arange(1, docs + 1)))
                cat = np.concatenate
                size = cat(sizes)
                tokens, first = with_ends(cat(numbers), size)
                own = gru.score(p, tokens, first, 0) / np.log(10.0) + cat(rare)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2), pa.array(size + 1), pa.array(cat(known).astype(np.int64) + (end_count > 0)), pa.array(cat(base) + np.log10(end_count + 1.0) - (size + 1) * base_norm), pa.array(own),
                        pa.ListArray.from_arrays(pa.array(cat(ends).astype(np.int32)), pa.array(signed(cat(tails)))),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"],
                )

    scored = map_arrow(rows.select("doc_id", "text", "held_out"), run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<long>")
    if counts.cut > 1:
        scored = pinned(scored).withColumn("row", F.monotonically_increasing_id())
        rare = table.where(F.col("n") < counts.cut)
        found = scored.select("row", F.explode("tail").alias("word")).join(rare, "word").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("add"))
        scored = scored.join(found, "row", "left").withColumn("n_known", F.col("n_known") + F.coalesce("more", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("add", F.lit(0.0))).withColumn("score", F.col("score") + F.coalesce("add", F.lit(0.0)))
    return scored.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
