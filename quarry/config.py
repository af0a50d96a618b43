"""Settings of the engine, from defaults, a TOML file, the environment and overrides, in rising order."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass


#: What may be empty: a service without a URL is replaced by the offline stand-in (embeddings) or left out (reranking); keys come from the environment variable named.
OPTIONAL = ("url", "model", "key_variable", "instruction")


@dataclass
class Embedding:
    dimension: int = 64
    tokenizer: str = "characters"
    context_length: int = 32_768
    max_batch_size: int = 15
    workers: int = 5
    requests_per_minute: int = 1000
    max_concurrent_requests: int = 300
    tokens_per_minute: int = 1_000_000
    url: str = ""
    model: str = ""
    key_variable: str = ""
    timeout_seconds: int = 30


@dataclass
class Reranker:
    url: str = ""
    model: str = ""
    key_variable: str = ""
    instruction: str = ""
    timeout_seconds: int = 10


@dataclass
class Prompt:
    tokenizer: str = "characters"


@dataclass
class Chunking:
    lines: int = 60
    overlap: float = 0.2
    max_file_size: int = 5_242_880


@dataclass
class History:
    depth: int = 10_240
    merges: bool = False
    commit_size_limit_ratio: float = 1.0


@dataclass
class Search:
    limit: int = 10
    min_score: float = 0.4
    hybrid_weight: float = 0.6


@dataclass
class Config:
    embedding: Embedding = field(default_factory=Embedding)
    chunking: Chunking = field(default_factory=Chunking)
    history: History = field(default_factory=History)
    search: Search = field(default_factory=Search)
    reranker: Reranker = field(default_factory=Reranker)
    prompt: Prompt = field(default_factory=Prompt)

    def problems(self) -> list[str]:
        """Counts must be positive, the overlap lie in [0, 1), scores, weights and ratios in [0, 1]."""
        out = []
        for section in fields(self):
            for name, value in asdict(getattr(self, section.name)).items():
                at = f"{section.name}.{name}"
                if isinstance(value, str) and not value.strip() and name not in OPTIONAL:
                    out.append(f"{at} must be set")
                elif isinstance(value, int) and not isinstance(value, bool) and value <= 0:
                    out.append(f"{at} must be above 0")
                elif isinstance(value, float) and not 0 <= value <= 1 or name == "overlap" and value >= 1:
                    out.append(f"{at} must lie in [0, 1" + (")" if name == "overlap" else "]"))
        return out


def load(path: str | None = None, overrides: dict[str, str] | None = None, environ: dict[str, str] | None = None) -> Config:
    """overrides are section.name: value; the environment has QUARRY_SECTION__NAME. Unknown names and values out of range are errors."""
    given: dict[str, object] = {}
    if path:
        with open(path, "rb") as f:
            given |= {f"{s}.{k}": v for s, part in tomllib.load(f).items() for k, v in part.items()}
    env = os.environ if environ is None else environ
    given |= {k[7:].lower().replace("__", ".", 1): v for k, v in env.items() if k.startswith("QUARRY_") and "__" in k}
    given |= overrides or {}
    config = Config()
    for name, value in given.items():
        section, _, key = name.partition(".")
        part = getattr(config, section, None)
        if not is_dataclass(part) or not hasattr(part, key):
            raise ValueError(f"no such setting: {name}")
        kind = type(getattr(part, key))
        setattr(part, key, str(value).lower() in ("1", "true", "yes") if kind is bool else kind(value))
    if found := config.problems():
        raise ValueError("; ".join(found))
    return config
