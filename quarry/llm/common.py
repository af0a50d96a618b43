"""Shared helpers: pinned intermediate results, text batches as arrays, hashing, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
#: Largest table, in bytes as a hash table, that a join sends to every executor; above it both sides are shuffled.
BROADCAST_BYTES = 24 << 20
#: Largest array of numbers, in rows, that goes to every Python worker; above it a join takes its place.
BROADCAST_ROWS = 1_500_000
#: Characters of text that a Python worker turns into arrays at a time.
BATCH_CHARS = 1_500_000

U = np.uint64
_MUL = U(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset, a local master gets one of its own and a cluster is refused."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="checkpoint")
            atexit.register(shutil.rmtree, at, True)
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


_OPEN = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    return _OPEN.scopes


@contextmanager
def scratch(spark: SparkSession):
    """Tables that pinned() writes while this is open go when it closes, but those that outlive it."""
    scopes = _scopes()
    scopes.append([])
    try:
        yield
    finally:
        for at in scopes.pop():
            removed(spark, at)


def removed(spark: SparkSession, at: str) -> None:
    """Deletes a table or folder of the shared folder."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's setting that frees a query's shuffle files when it ends; nothing reads those of a table that has been written.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, at: str) -> DataFrame:
    """df as a Parquet table in the folder at, read again; the shuffle files behind it are freed."""
    spark = df.sparkSession
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(_FREE, before) if before is not None else spark.conf.unset(_FREE)
    return spark.read.schema(df.schema).parquet(at)


def pinned(df: DataFrame, outlives: bool = False) -> DataFrame:
    """Computes df once, as a table in the shared folder, so that a lost executor costs no recomputation.

    The table goes with the innermost scratch() that is open, or, if it outlives that, with the one around it.
    """
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    scopes = _scopes()
    if len(scopes) > outlives:
        scopes[-1 - outlives].append(at)
    return written(df, at)


def bounded(df: DataFrame, most: int | None = None) -> DataFrame:
    """A broadcast hint if df, already pinned, takes at most so many bytes as a hash table; else df, which is then shuffled."""
    wide = sum({"string": 48, "binary": 32, "boolean": 8}.get(kind, 8 if "<" not in kind else 256) for _, kind in df.dtypes) + 48
    rows = (BROADCAST_BYTES if most is None else most) // wide
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(name: str, *tables: DataFrame) -> str:
    """name, with underscores before it until no column of the tables has it, in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def own(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df but those named, as they are."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in names]


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(texts: list[str], chars: int = BATCH_CHARS):
    """(from, to) of consecutive texts of about so many characters; a longer text stands alone, whole."""
    at = total = 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > chars:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)


def pieces(batch, columns: tuple[int, ...], most: int = BATCH_CHARS):
    """Consecutive parts of an Arrow batch, of about so many bytes of text in its columns; a longer row stands alone, whole."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    at = total = 0
    for i, n in enumerate(size.tolist()):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=U) * _MUL)
_ODD, _BACK = U(0xD6E8FEB86659FD93), U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_POWERS = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for k, base in ((0, _ODD), (1, _BACK)):
                _POWERS[k] = np.cumprod(np.r_[U(1), np.full(size - 1, base, U)])
    return _POWERS[0][:n], _POWERS[1][:n]


class Words:
    """The words of some texts: 64-bit hashes, byte spans in data, and where each text's words begin (first, one more at the end)."""

    def __init__(self, texts: list[str], ascii_lower: bool = False):
        raw = "\n".join(texts).encode("utf-8", "surrogatepass") + b"\n"
        raw = raw.lower() if ascii_lower else raw
        self.data = np.frombuffer(raw, np.uint8)
        self.raw = raw
        if texts and "".join(texts).isascii():
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        else:
            lengths = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
        self.text_end = np.cumsum(lengths + 1) - 1
        self.text_start = self.text_end - lengths
        self.space = _SPACE[self.data]
        word = np.r_[False, ~self.space, False].astype(np.int8)
        edge = np.diff(word)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.r_[np.searchsorted(self.start, self.text_start), len(self.start)] if texts else np.zeros(1, np.int64)
        up, down = _powers(len(self.data))
        sums = np.r_[U(0), np.cumsum(_BYTE[self.data] * up)]
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U) * _MUL) if len(self.start) else np.zeros(0, U)
        self.count = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(texts)), self.count)

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]]

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of n words, and their text; a text of fewer words, but some, is one shingle."""
        h = self.hash
        if not len(h):
            return h, self.text_of
        after = np.repeat(self.first[1:], self.count) - np.arange(len(h))
        short = np.repeat(self.count < n, self.count)
        head = np.r_[True, self.text_of[1:] != self.text_of[:-1]]
        keep = (after >= n) | (short & head)
        out = np.zeros(len(h), U)
        for k in range(n):
            moved = np.zeros(len(h), U)
            moved[: max(0, len(h) - k)] = h[k:]
            moved[after <= k] = U(k)
            out = mix(out * _ODD + moved)
        return out[keep], self.text_of[keep]


def run_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run h[start:end], the same wherever the run stands."""
    up, down = _powers(len(h) + 1)
    sums = np.r_[U(0), np.cumsum(h * up[: len(h)])]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * _MUL)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def per_text(values: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text_of, weights=values, minlength=n)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links(a, b): root is the least node that can be reached.

    Alternating large-star and small-star steps: each moves links towards lesser nodes, no step
    gathers a node's links in one task beyond a minimum, and the number of steps grows with the
    logarithm of the longest path. Ends when no link changes.
    """
    spark, state = links.sparkSession, None
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    with scratch(spark):
        while True:
            links = pinned(links)
            got = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
            if not got["n"] or tuple(got) == state:
                return pinned(links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()), outlives=True)
            state = tuple(got)
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
            up = large.groupBy("b").agg(F.min("a").alias("m"))
            links = large.join(up, "b").select(F.col("m").alias("x"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("y")).where("x < y").distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))


__all__ = ["BROADCAST_BYTES", "BROADCAST_ROWS", "WORD", "Words", "bounded", "components", "held_out", "mix", "own", "per_text", "pieces", "pinned", "removed", "scratch", "shared_folder", "signed", "slices", "table", "unused", "written"]
