"""The repository's summary: ranked files with badges and partners, and the directory tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from . import graph
from .history import both_ways

RANKED, CORE, CHURN, PARTNERS, MOST_LINES, MOST_DEPTH = 20, 5, 10, 3, 400, 4


def summary(files: DataFrame, edges: DataFrame, commits: DataFrame, cochange: DataFrame) -> DataFrame:
    """(path, rank, badges, partners) of every file; the last three only for the highest ranked."""
    top = graph.pagerank(edges).orderBy(F.desc("rank"), "path").limit(RANKED)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank"), "path")))  # at most RANKED rows
    churn = commits.join(F.broadcast(top.select("path")), "path", "left_semi").groupBy("path").agg(F.countDistinct("commit_id").alias("n"))
    near = both_ways(cochange).join(F.broadcast(top.select(F.col("path").alias("src"))), "src").groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    order = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= PARTNERS).groupBy(F.col("src").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "dst", "w"))), lambda x: F.format_string("%s (%.2f)", x["dst"], x["w"])), ", ").alias("partners"))
    badge = lambda c, name: F.when(c, F.lit(f"[{name}]"))
    badges = F.array_join(F.array_compact(F.array(badge(F.col("place") <= CORE, "core"), badge(P.is_test(F.col("path")), "test"), badge(F.coalesce("n", F.lit(0)) >= CHURN, "high-churn"))), " ")
    ranked = top.join(churn, "path", "left").join(near, "path", "left").select("path", "rank", badges.alias("badges"), F.coalesce("partners", F.lit("")).alias("partners"))
    return files.select("path").join(F.broadcast(ranked), "path", "left").select("path", "rank", F.coalesce("badges", F.lit("")).alias("badges"), F.coalesce("partners", F.lit("")).alias("partners"))


@dataclass
class _Folder:
    folders: dict[str, _Folder] = field(default_factory=dict)
    files: list[tuple[str, object]] = field(default_factory=list)


def tree_lines(rows: list, most: int = MOST_LINES, deepest: int = MOST_DEPTH) -> list[str]:
    """Lines of the directory tree of summary rows: folders, then files, each by name."""
    top = _Folder()
    for r in rows:
        at, parts = top, [p for p in r["path"].split("/") if p]
        for p in parts[:-1]:
            at = at.folders.setdefault(p, _Folder())
        if parts:
            at.files.append((parts[-1], r))
    out: list[str] = []
    todo = [(iter(_listed(top)), "", 0)]
    while todo and len(out) < most:
        entries, prefix, depth = todo[-1]
        entry = next(entries, None)
        if entry is None:
            todo.pop()
            continue
        last, name, what = entry
        below = prefix + ("    " if last else "│   ")
        if isinstance(what, _Folder):
            out.append(f"{prefix}{'└── ' if last else '├── '}{name}/")
            if depth < deepest:
                todo.append((iter(_listed(what)), below, depth + 1))
            continue
        rank = "" if what["rank"] is None else f" (rank {what['rank']:.4f})"
        out.append(f"{prefix}{'└── ' if last else '├── '}{name}{' ' + what['badges'] if what['badges'] else ''}{rank}")
        if what["partners"] and len(out) < most:
            out.append(f"{below}↔ changes with: {what['partners']}")
    return out


def _listed(folder: _Folder) -> list[tuple[bool, str, object]]:
    both = [*sorted(folder.folders.items()), *sorted(folder.files, key=lambda f: f[0])]
    return [(i + 1 == len(both), name, what) for i, (name, what) in enumerate(both)]


def repo_tree(rows: DataFrame, most: int = MOST_LINES, deepest: int = MOST_DEPTH) -> DataFrame:
    """(line_no, line) of the tree of summary rows.

    Files below the deepest folders shown are one entry, so each path read gives a line at least and
    the first `most` and one more suffice; beside them the last path of each folder on the way to the
    last one read, for whether a later sibling follows.
    """
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    shown = F.when(F.size(parts) > deepest + 1, F.concat(F.array_join(F.slice(parts, 1, deepest + 1), "/"), F.lit("/_"))).otherwise(F.col("path"))
    # folders come before files
    key = F.transform(parts, lambda p, i: F.concat(F.when(i < F.size(parts) - 1, F.lit("0")).otherwise(F.lit("1")), p))
    rows = rows.where("path is not null").withColumn("path", shown).dropDuplicates(["path"]).withColumn("_key", key)
    first = rows.orderBy("_key").limit(most + 1).collect()
    out = [r.asDict() for r in first]
    if len(first) > most:
        last = first[-1]["_key"]
        begins = lambda d: F.slice("_key", 1, d) == F.array(*[F.lit(x) for x in last[:d]]) if d else F.lit(True)
        ends = rows.agg(*[F.max(F.when(begins(d), F.struct("_key", "path"))).alias(f"e{d}") for d in range(len(last))]).first()
        later = {e["path"] for e in ends if e["_key"] > last}
        out += [{"path": p, "rank": None, "badges": "", "partners": ""} for p in sorted(later)]
    return rows.sparkSession.createDataFrame(list(enumerate(tree_lines(out, most, deepest), 1)), "line_no int, line string")


def prompt(blocks: list[str], overview: dict, warnings: list[str], task: str, sections: set[str] | None = None, expanded: list[str] = []) -> str:
    """The assembled Markdown: blocks asked for or found, then those from around them. overview has name, tech_stack and summary; no sections given: all."""
    on = lambda s: not sections or s in sections
    out: list[str] = []
    if on("summary") or on("structure"):
        out.append(f"## Repository: {overview['name']}")
        if on("summary") and overview["tech_stack"]:
            out.append("Tech stack: " + ", ".join(overview["tech_stack"]))
        if on("summary") and overview["summary"]:
            out += ["\n### Summary Map\n<SUMMARY_MAP>\n```", *overview["summary"], "```\n</SUMMARY_MAP>"]
    if warnings:
        out += ["\n## Warnings\n<WARNINGS>", *(f"- {w}" for w in warnings), "</WARNINGS>"]
    if on("context"):
        out.append(f"\n## Retrieved Context ({len(blocks) + len(expanded)} blocks)")
        for label, group in (("Primary Results", blocks), ("Expanded Context", expanded)):
            out += [f"\n### {label}", *[f"\n{b}" for b in group]]
    if on("query"):
        out.append(f"\n## User Query\n<USER_QUERY>\n{task}\n</USER_QUERY>")
    return "\n".join(out) + "\n"
