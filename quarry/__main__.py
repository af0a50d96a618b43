"""The command line: index a tree or its history, search it, assemble a prompt, show its topology, show the settings."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import SparkSession

from . import config as settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("--data", default=".quarry", help="folder of the tables")
    p.add_argument("--config", help="settings as TOML")
    p.add_argument("--set", action="append", default=[], metavar="SECTION.NAME=VALUE")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("folder")
    sub.add_parser("history").add_argument("folder", help="a Git work tree")
    find = sub.add_parser("search")
    find.add_argument("query")
    find.add_argument("--prefix", action="append", default=[])
    find.add_argument("--extension", action="append", default=[])
    find.add_argument("--min-score", type=float)
    ask = sub.add_parser("prompt", help="the Markdown of a task and its context")
    ask.add_argument("task")
    for name in ("scope", "include", "exclude", "pin"):
        ask.add_argument(f"--{name}", action="append", default=[])
    ask.add_argument("--section", action="append", default=[], choices=["structure", "summary", "context", "query"], help="none given: all")
    ask.add_argument("--max-tokens", type=int, default=0, help="0: as many as the embedder's context holds")
    ask.add_argument("--reserved-output-tokens", type=int, default=0)
    ask.add_argument("--tokenizer", default="", help="characters, hf:PATH or tiktoken:NAME")
    ask.add_argument("--topology", action="store_true", help="by the dependency graph around included and pinned files, not by search")
    ask.add_argument("--topology-depth", type=int, default=1)
    ask.add_argument("--topology-limit", type=int, default=25)
    ask.add_argument("--topology-per-file", type=int, default=5)
    sub.add_parser("topology")
    sub.add_parser("config")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    config = settings.load(a.config, dict(x.split("=", 1) for x in a.set))
    if a.command == "config":
        print(json.dumps(asdict(config), indent=2))
        return
    from .engine import Engine
    from .sources.git import GitSource

    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    engine = Engine(spark, a.data, config)
    if a.command == "index":
        engine.index(a.folder)
    elif a.command == "history":
        spark.dataSource.register(GitSource)
        engine.index_history(spark.read.format("quarry_git").option("path", a.folder).load().select("commit_id", "path"))
    elif a.command == "search":
        for r in engine.search(a.query, a.prefix, a.extension, a.min_score).collect():
            print(f"{r['score']:.4f} {r['path']}:{r['start_byte']}-{r['end_byte']}")
    elif a.command == "prompt":
        from .prompt import Selection, prompt

        print(prompt(engine, a.task, Selection(a.scope, a.include, a.exclude, a.pin), set(a.section), a.max_tokens, a.reserved_output_tokens, a.tokenizer, a.topology, a.topology_depth, a.topology_limit, a.topology_per_file), end="")
    else:
        print(json.dumps(engine.topology().first().asDict()))


if __name__ == "__main__":
    main()
