"""Embeddings, reranking and token counts from outside, with offline stand-ins; limits and retries for network clients."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .text import tokens

#: Limits of requests.
REQUESTS_A_MINUTE, TOKENS_A_MINUTE, BURST_SECONDS, BATCH_ITEMS, BATCH_TOKENS = 1000, 1_000_000, 10, 15, 32_768
RETRIES, LONGEST_WAIT, RETRY_STATUS = 3, 60, frozenset((429, 500, 502, 503, 504))


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Bucket:
    """A token bucket that holds BURST_SECONDS of its rate."""

    def __init__(self, a_minute: float, now: Callable[[], float] = time.monotonic):
        self.rate, self.now = a_minute / 60, now
        self.most = self.level = self.rate * BURST_SECONDS
        self.at = now()

    def wait_for(self, n: float) -> float:
        """Takes n and returns 0, or the seconds until that can be done; more than the bucket holds is taken from a full one."""
        t = self.now()
        self.level, self.at = min(self.most, self.level + (t - self.at) * self.rate), t
        n = min(n, self.most)
        if self.level >= n:
            self.level -= n
            return 0.0
        return (n - self.level) / self.rate


def backoff(attempt: int) -> float:
    return float(min(2**attempt, LONGEST_WAIT))


def with_retries(call: Callable[[], tuple[int, object]], sleep: Callable[[float], None] = time.sleep) -> object:
    """The body of the first answer that is no error; a status worth it, or a broken connection, is tried again up to RETRIES times."""
    for attempt in range(RETRIES + 1):
        try:
            status, body = call()
        except (ConnectionError, TimeoutError):
            if attempt == RETRIES:
                raise
        else:
            if status < 400:
                return body
            if status not in RETRY_STATUS or attempt == RETRIES:
                raise RuntimeError(f"status {status}")
        sleep(backoff(attempt))
    raise AssertionError


def batches(sizes: list[int], items: int = BATCH_ITEMS, most: int = BATCH_TOKENS) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive items within both limits; a larger item goes alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= items or total + n > most):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def hashed_embedder(dimension: int) -> Embedder:
    """Offline: words hashed into a unit vector, the same everywhere."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimension))
        for row, t in zip(out, texts, strict=True):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                row[h % dimension] += 1.0 if h & 0x10000 else -1.0
            row /= np.linalg.norm(row) or 1.0
        return out.tolist()

    return embed


def embedded(chunks: DataFrame, make: Callable[[], Embedder], partitions: int = 5, requests: float = REQUESTS_A_MINUTE, tokens_a_minute: float = TOKENS_A_MINUTE, items: int = BATCH_ITEMS, most: int = BATCH_TOKENS) -> DataFrame:
    """(id, embedding) of chunks(id, text). Each partition is a worker with its share of the rates; make builds its client there."""
    ship(chunks.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, calls, size = make(), Bucket(requests / partitions), Bucket(tokens_a_minute / partitions)
        for f in frames:
            texts = f.text.fillna("").tolist()
            for a, b in batches([len(t) for t in texts], items, most):
                for bucket, n in ((calls, 1), (size, sum(map(len, texts[a:b])))):
                    while wait := bucket.wait_for(n):
                        time.sleep(wait)
                yield pd.DataFrame({"id": f.id[a:b].tolist(), "embedding": client(texts[a:b])})

    return chunks.select("id", "text").repartition(partitions).mapInPandas(run, f"id {dict(chunks.dtypes)['id']}, embedding array<float>")


def overlap(query: str, text: Column) -> Column:
    """Offline reranking: the share of the query's distinct words that a text holds."""
    words = F.array_distinct(tokens(F.lit(query)))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, tokens(text))) / F.size(words)).otherwise(F.lit(0.0))


def token_count(text: Column, kind: str = "characters", path: str | None = None) -> Column:
    """characters, or the tokens of a vocabulary file of the tokenizers library (kind hf, with its path)."""
    if kind == "characters":
        return F.char_length(text)
    if kind != "hf" or not path:
        raise ValueError(f"no such tokenizer: {kind}")

    @F.pandas_udf("int")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        for s in texts:
            yield pd.Series([len(e.ids) for e in t.encode_batch(s.fillna("").tolist(), add_special_tokens=False)])

    return count(text)


def counter(tokenizer: str) -> Callable[[str], int]:
    """Tokens of one text: characters, hf:PATH (a file of the tokenizers library) or tiktoken:NAME (an encoding that library has at hand)."""
    kind, _, name = tokenizer.partition(":")
    if tokenizer == "characters":
        return len
    if kind == "hf" and name:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(name)
        return lambda t: len(own.encode(t, add_special_tokens=False).ids)
    if kind == "tiktoken" and name:
        import tiktoken

        encoding = tiktoken.get_encoding(name)
        return lambda t: len(encoding.encode_ordinary(t))
    raise ValueError(f"no such tokenizer: {tokenizer}")
