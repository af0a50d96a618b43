"""Clients of embedding and reranking services over HTTP, with the standard library alone."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass

from .providers import with_retries


def headers(key: str | None) -> dict[str, str]:
    """A key that cannot stand in a header is an error before any request."""
    if key and any(ord(c) < 32 or ord(c) == 127 for c in key):
        raise ValueError("the API key holds characters that a header cannot")
    return {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})


def post(url: str, body: dict, head: dict[str, str], timeout: float) -> tuple[int, object]:
    """Status and decoded body; the body of an error is left out. A connection that fails raises ConnectionError."""
    request = urllib.request.Request(url, json.dumps(body).encode(), head)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, json.load(answer)
    except urllib.error.HTTPError as e:
        return e.code, None
    except urllib.error.URLError as e:
        raise ConnectionError(str(e.reason)) from e


@dataclass
class Embeddings:
    """Vectors of texts, in the order of the texts whatever the order of the answer."""

    url: str
    model: str
    dimension: int
    key: str | None = None
    timeout: float = 30

    def __post_init__(self) -> None:
        headers(self.key)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        body = {"input": texts, "model": self.model, "encoding_format": "float", "dimensions": self.dimension}
        data = with_retries(lambda: post(f"{self.url}/embeddings", body, headers(self.key), self.timeout))["data"]
        by_index = {x["index"]: x["embedding"] for x in data}
        if sorted(by_index) != list(range(len(texts))):
            raise ValueError(f"{len(data)} embeddings came for {len(texts)} texts")
        return [by_index[i] for i in range(len(texts))]


@dataclass
class Reranker:
    """Scores in [0, 1] of documents for a query, one for each document."""

    url: str
    model: str
    key: str | None = None
    instruction: str | None = None
    timeout: float = 10

    def __post_init__(self) -> None:
        headers(self.key)

    def __call__(self, query: str, documents: list[str]) -> list[float]:
        if not documents:
            return []
        if not query.strip():
            raise ValueError("the query is empty")
        body = {"queries": [query] * len(documents), "documents": documents} | ({"instruction": self.instruction} if self.instruction else {})
        status, answer = post(f"{self.url}/inference/{self.model}", body, headers(self.key), self.timeout)
        if status >= 400:
            raise RuntimeError(f"status {status}")
        return [min(1.0, max(0.0, float(s))) for s in answer["scores"]]
