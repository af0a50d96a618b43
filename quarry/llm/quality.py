"""Quality rules: word counts and repeats, and perplexity bands of an n-gram model.

The model is a modified Kneser-Ney model of the characters of the text, order 4, for each language;
a character's context goes on over the space before a word, case is kept, and any white space counts
as one space. Spark counts the n-grams of all documents, and the probabilities stand in sorted hash
arrays. A document's perplexity (per character) must lie between its language's lower and upper band,
which lie REACH interquartile ranges outside the quartiles of the documents that pass the base rules;
outside the band it is rejected.

Defined cases: a null or empty text has no words and fails; a null language is a language of its own;
rows that repeat or share an id are judged each, with the same result; a perplexity on a band's edge
is inside; very long texts are read whole; an empty table gives an empty result; extra columns are
ignored by judge() and kept by keep().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import Words, bounded, mix, own, per_text, pieces, pinned, scratch, unused
from .ngrams import collected, counted, distinct, lookup, summed, word_texts

ORDER, SPACE = 4, np.uint64(32)
#: The bands lie so many interquartile ranges (of LEAST_RANGE nats at least, for a table of equal texts) outside the quartiles of log-perplexity.
REACH, LEAST_RANGE = 3.0, 0.005
#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_B = np.uint64(16)


def discounts(n: np.ndarray) -> np.ndarray:
    """What is taken from a count of 0, 1, 2, and 3 or more, from how many grams have 1 to 4; halves where a table lacks one of these."""
    one, two, three, four = (int((n == i).sum()) for i in (1, 2, 3, 4))
    if not (one and two and three and four):
        return np.array([0, 0.5, 1.0, 1.5])
    y = one / (one + 2 * two)
    return np.clip([0, 1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three], 0, [0, 1, 2, 3])


class Kneser:
    """Modified Kneser-Ney probabilities of packed n-grams, from counts of the highest order alone."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = ORDER
        self.tables = []
        levels = {order: (keys, counts)}
        for k in range(order - 1, 0, -1):
            up, mask = levels[k + 1][0], np.uint64((1 << (16 * k)) - 1)
            # a gram counts by the different characters before it
            levels[k] = summed(up & mask, np.ones(len(up), np.int64))
        chars = max(2, len(levels[1][0]))
        self.uniform = float(np.log(1.0 / (chars + 1)))
        lower = None
        for k in range(1, order + 1):
            grams_k, n = levels[k]
            cut = discounts(n)
            head, at = np.unique(grams_k >> _B, return_inverse=True)
            d = cut[np.minimum(n, 3)]
            total = np.bincount(at, weights=n)
            left = np.bincount(at, weights=d) / total
            if lower is None:
                below = np.full(len(grams_k), np.exp(self.uniform))
            else:
                place, _ = lookup(lower[0], grams_k & np.uint64((1 << (16 * (k - 1))) - 1))
                below = lower[1][place]
            p = (n - d) / total[at] + left[at] * below
            lower = (grams_k, p)
            gram_hash, head_hash = mix(grams_k), mix(head)
            a, b = np.argsort(gram_hash), np.argsort(head_hash)
            self.tables.append((gram_hash[a], np.log(p[a]).astype(np.float32), head_hash[b], np.log(np.maximum(left[b], 1e-9)).astype(np.float32)))

    def logp(self, keys: np.ndarray) -> np.ndarray:
        """log-probability of each gram's last character after those before it, backing off where it was not seen."""
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            gram, p, head, left = self.tables[k - 1]
            own = keys[open_] & np.uint64((1 << (16 * k)) - 1) if k < 4 else keys[open_]
            at, hit = lookup(gram, mix(own))
            out[open_[hit]] += p[at[hit]]
            open_, own = open_[~hit], own[~hit]
            if not len(open_):
                return out
            at, hit = lookup(head, mix(own >> _B))
            out[open_[hit]] += left[at[hit]]
        out[open_] += self.uniform
        return out


class Characters:
    """The 4-grams of some texts: those that lie inside a distinct word with the space before and after it, and those that cross into a word from the one before."""

    def __init__(self, w: Words):
        first, self.at = distinct(w.hash)
        words = word_texts(w, first)
        length = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) & np.uint64(0xFFFF)
        start = np.cumsum(length + 1) - length
        ends = np.repeat(start + 1, length - 1) + np.arange(int((length - 1).sum())) - np.repeat(np.cumsum(length - 1) - (length - 1), length - 1) + 1
        self.word = np.repeat(np.arange(len(words)), length - 1)
        self.inside = (flat[ends - 3] << np.uint64(48)) | (flat[ends - 2] << _B * np.uint64(2)) | (flat[ends - 1] << _B) | flat[ends]
        tail = (flat[start + length - 2] << _B) | flat[start + length - 1]
        head = (flat[start] << _B) | flat[start + 1]
        before = np.r_[np.uint64(0), tail[self.at[:-1]]]
        before[np.r_[True, w.text_of[1:] != w.text_of[:-1]]] = (SPACE << _B) | SPACE
        # the two characters before the space and the two after it, of each word that stands in a text
        self.cross = (before << np.uint64(32)) | head[self.at]
        self.size = length + 1

    @staticmethod
    def crossing(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 4-grams that end at the first and at the second character after the space."""
        head, second = pairs & np.uint64(0xFFFFFFFF), (pairs >> np.uint64(32)) & np.uint64(0xFFFF)
        return (pairs >> np.uint64(32) << np.uint64(32)) | (SPACE << _B) | (head >> _B), (second << np.uint64(48)) | (SPACE << np.uint64(32)) | head


def characters(texts: list[str], labels: np.ndarray):
    """(label, grams, n) of the texts of each label."""
    w = Words(texts)
    if not len(w.hash):
        return
    c = Characters(w)
    for label in set(labels):
        mine = (labels == label)[w.text_of]
        n = np.bincount(c.at[mine], minlength=len(c.size))[c.word]
        pairs, times = np.unique(c.cross[mine], return_counts=True)
        keys, counts = np.concatenate([c.inside, *c.crossing(pairs)]), np.concatenate([n, times, times])
        yield label, *summed(keys[counts > 0], counts[counts > 0])


def learn(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> dict[str, Kneser]:
    return {k: Kneser(*v) for k, v in collected(counted(docs, characters, text_col, label_col)).items() if len(v[0])}


def measured(docs: DataFrame, models: dict[str, Kneser], id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The base measures of every row, with log_ppl: nats per character under the model of its language (null without words or model)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("lang"))
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        ms = shared.value
        for batch in batches:
            for rows in pieces(batch, (1,)):
                part, langs, n = rows.column(1).to_pylist(), np.array(rows.column(2).to_pylist(), object), rows.num_rows
                w = Words(part)
                inside = np.r_[0, np.cumsum(~w.space & ((w.data & 0xC0) != 0x80))]
                symbols = np.r_[0, np.cumsum(_SYMBOL[w.data])]
                chars = inside[w.text_end] - inside[w.text_start]
                dup = np.zeros(n, np.int64)
                for i, t in enumerate(part):
                    if "\n" in t:
                        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
                        dup[i] = len(lines) - len(set(lines))
                repeat = np.zeros(n)
                if len(w.hash) > 2:
                    whole = np.flatnonzero((np.repeat(w.first[1:], w.count) - np.arange(len(w.hash))) >= 3)
                    h = w.hash
                    three = mix(mix(mix(h[whole] + np.uint64(1)) + h[whole + 1]) + h[whole + 2]) ^ mix(w.text_of[whole].astype(np.uint64) + np.uint64(7))
                    order = np.argsort(three)
                    same = three[order][1:] == three[order][:-1]
                    twice = np.zeros(len(whole), bool)
                    twice[order[1:][same]] = True
                    twice[order[:-1][same]] = True
                    hit = np.zeros(len(h), bool)
                    for k in range(3):
                        hit[whole[twice] + k] = True
                    repeat = per_text(hit, w.text_of, n)
                lp = np.full(n, np.nan)
                if len(w.hash):
                    c = Characters(w)
                    for lang in set(langs) & ms.keys():
                        mine = np.flatnonzero((langs == lang)[w.text_of])
                        use = np.zeros(len(c.size), bool)
                        use[c.at[mine]] = True
                        pick = use[c.word]
                        per_word = np.bincount(c.word[pick], weights=ms[lang].logp(c.inside[pick]), minlength=len(c.size))
                        pairs, of = np.unique(c.cross[mine], return_inverse=True)
                        per_pair = sum(ms[lang].logp(g) for g in c.crossing(pairs))
                        t = w.text_of[mine]
                        total, length = per_text(per_word[c.at[mine]] + per_pair[of], t, n), per_text(c.size[c.at[mine]], t, n)
                        np.divide(-total, length, out=lp, where=length > 0)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), *[pa.array(np.asarray(x).astype(np.int64)) for x in (w.count, chars, symbols[w.text_end] - symbols[w.text_start], dup, repeat)], pa.array(lp, from_pandas=True)],
                    names=["id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl"],
                )

    return map_arrow(rows, run, f"id {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double")


def bands(rows: DataFrame) -> DataFrame:
    """(lang, low, high) of log-perplexity, from the quartiles of the documents that the base rules keep."""
    q = rows.where("n_words >= %d and 100 * n_repeat_words <= %d * n_words" % (LEAST_WORDS, MOST_REPEATED)).groupBy("lang").agg(F.percentile_approx("log_ppl", [0.25, 0.75], 10_000).alias("q"))
    reach = REACH * F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_RANGE))
    return q.select(F.col("lang").alias("band_lang"), (F.col("q")[0] - reach).alias("low"), (F.col("q")[1] + reach).alias("high"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """id, the base measures, base_failed, kept and log_ppl of every row."""
    models = learn(docs, text_col, label_col)
    with scratch(docs.sparkSession):
        rows = pinned(measured(docs, models, id_col, text_col, label_col), outlives=True)
        limits = pinned(bands(rows), outlives=True)
    found = rows.join(bounded(limits), F.col("lang") == F.col("band_lang"), "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return found.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"), "log_ppl")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, in their own columns.

    The verdict is carried by row content (id, text, language), so rows that share an id are judged each.
    """
    name = unused("key", docs)
    at = lambda c: F.col(f"`{c}`")
    key = F.sha2(F.concat_ws("\x01", F.coalesce(at(id_col).cast("string"), F.lit("\x02")), F.coalesce(at(label_col).cast("string"), F.lit("\x02")), F.coalesce(at(text_col), F.lit(""))), 256)
    with scratch(docs.sparkSession):
        good = judge(docs.select(key.alias("key"), at(text_col).alias("text"), at(label_col).alias("lang")), "key", "text", "lang").where("kept")
        good = pinned(good.select(F.col("key").alias(name)).distinct(), outlives=True)
    return docs.withColumn(name, key).join(bounded(good), name, "left_semi").select(*own(docs))
