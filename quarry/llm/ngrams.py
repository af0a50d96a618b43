"""Character n-grams inside words, packed into 64 bits, and their corpus counts.

A word is lower-cased and gets a begin mark before it and an end mark after it; an n-gram holds up
to four characters of 16 bits each (characters beyond the basic plane share codes, which only
merges rare grams). Distinct words of a batch are counted once with their frequency.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import Words, pieces, pinned, scratch, signed

BEGIN, END = np.uint64(1), np.uint64(2)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct hashes, and for every hash the place of its own among them."""
    _, first, at = np.unique(hashes, return_index=True, return_inverse=True)
    return first, at


def grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams that end at each character and at the end mark of each word, and their word's place."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    cps = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) & np.uint64(0xFFFF)
    pad = order - 1
    size = lengths + 1 + pad
    ends = np.cumsum(size)
    starts = ends - size
    flat = np.full(int(ends[-1]) if len(words) else 0, BEGIN, np.uint64)
    of = np.repeat(np.arange(len(words)), lengths)
    inner = np.arange(len(cps)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[starts[of] + pad + inner] = cps
    flat[ends - 1] = END
    key = np.zeros(len(flat), np.uint64)
    for k in range(order):
        key[pad:] |= flat[pad - k : len(flat) - k] << np.uint64(16 * k)
    at = np.arange(len(flat)) - np.repeat(starts, size)
    keep = at >= pad
    return key[keep], np.repeat(np.arange(len(words)), lengths + 1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(keys, return_inverse=True)
    return k, np.bincount(at, weights=counts, minlength=len(k)).astype(np.int64)


def word_texts(w: Words, first: np.ndarray) -> list[str]:
    return [w.word(i).decode("utf-8", "replace") for i in first.tolist()]


def tallied(texts: list[str], labels: np.ndarray, order: int):
    """(label, grams, n): the n-grams inside the lower-cased words of the texts of each label."""
    w = Words([t.lower() for t in texts])
    if not len(w.hash):
        return
    first, at = distinct(w.hash)
    keys, word = grams(word_texts(w, first), order)
    for label in set(labels):
        n = np.bincount(at[(labels == label)[w.text_of]], minlength=len(first))
        got = n[word] > 0
        yield label, *summed(keys[got], n[word][got])


def counted(docs: DataFrame, tally: Callable, text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(label, gram, n) over all rows of docs, as tally(texts, labels) finds them; each task adds up its own before the shuffle."""

    def run(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for part in pieces(batch, (0,)):
                labels = np.array([x or "" for x in part.column(1).to_pylist()], object)
                for label, keys, n in tally([t or "" for t in part.column(0).to_pylist()], labels):
                    held.setdefault(label, []).append((keys, n))
                    if len(held[label]) > 8:
                        held[label] = [summed(np.concatenate([k for k, _ in held[label]]), np.concatenate([c for _, c in held[label]]))]
        for label, parts in held.items():
            k, c = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
            for i in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(k[i : i + 100_000]), pa.string()), pa.array(signed(k[i : i + 100_000])), pa.array(c[i : i + 100_000])], names=["label", "gram", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("label"))
    return map_arrow(rows, run, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def collected(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """{label: (grams, n)}: all grams, sorted, whatever the size of the corpus."""
    with scratch(counts.sparkSession):
        t = pinned(counts).toArrow()
    labels = t.column("label").combine_chunks().dictionary_encode()
    keys, n = t.column("gram").to_numpy().view(np.uint64), t.column("n").to_numpy()
    order = np.lexsort((keys, labels.indices.to_numpy()))
    ends = np.cumsum(np.bincount(labels.indices.to_numpy(), minlength=len(labels.dictionary)))
    parts = {label: order[i:j] for label, i, j in zip(labels.dictionary.to_pylist(), np.r_[0, ends], ends)}
    return {label: (keys[own], n[own].astype(np.int64)) for label, own in sorted(parts.items())}


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys
