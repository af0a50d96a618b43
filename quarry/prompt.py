"""From a task to its prompt: retrieve, expand, budget, enrich, render; or by the dependency graph around seeds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .engine import Engine
from .functions import paths as P
from .functions import providers
from .operators import assembly, history, render, topology
from .operators.checkpoints import pinned

#: Chunks of a file that expansion adds, and the sections of a prompt.
EXPANDED_PER_FILE = 3
SECTIONS = ("structure", "summary", "context", "query")


@dataclass
class Selection:
    """Paths of the user: prefixes to stay in or out of, files to include or pin."""

    scopes: list[str] = field(default_factory=list)
    includes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    pins: list[str] = field(default_factory=list)

    def keeps(self, path: Column) -> Column:
        return P.allowed(path, self.scopes, self.excludes)


def _chunks(engine: Engine) -> DataFrame:
    return engine.catalog.table("chunks").select("id", F.col("file_path").alias("path"), "ordinal", "start_byte", "end_byte", "start_line", "end_line", "text")


def _named(engine: Engine, given: list[str]) -> DataFrame:
    """(given, path): the user's paths and what they are called in the index; blank ones are left out."""
    rows = engine.spark.createDataFrame([(x,) for x in given if x.strip()], "given string")
    return rows.select("given", P.seed(F.trim("given"), engine.catalog.noted("root", "")).alias("path"))


def _warned(rows: DataFrame) -> list[str]:
    return [r["warning"] for r in rows.collect()]


def retrieved(engine: Engine, task: str, selection: Selection) -> tuple[DataFrame, list[str]]:
    """Blocks of included and pinned files, of the search for the task, and of files that change with any of these; and warnings of files that are not there."""
    chunks, limit = _chunks(engine), engine.config.search.limit
    includes, pins = _named(engine, selection.includes), _named(engine, selection.pins)
    warnings = _warned(assembly.missing(includes, chunks.select("path"), "explicit include")) + _warned(assembly.missing(pins, chunks.select("path"), "pinned item"))
    hits = engine.search(task).where(selection.keeps(F.col("path"))).select("id", "score")
    blocks = pinned(assembly.tiers(chunks, includes, pins, hits, limit))
    return blocks.unionByName(expanded(engine, chunks, blocks, selection)), warnings


def expanded(engine: Engine, chunks: DataFrame, blocks: DataFrame, selection: Selection) -> DataFrame:
    """The first chunks, with score 0, of the files that change most with those of blocks; the limit comes first, then the scope."""
    near = history.neighbours(engine.catalog.table("file_cochange_edges"), blocks.select("path").distinct(), engine.config.search.limit)
    files = near.where(selection.keeps(F.col("path"))).select("path")
    return assembly.first_chunks(chunks, files, EXPANDED_PER_FILE).withColumns({"score": F.lit(0.0), "source": F.lit("expanded")})


def seeds(engine: Engine, selection: Selection) -> tuple[DataFrame, list[str]]:
    """(path, source) of the pinned and included files that are known and allowed, and warnings of the others; a file that is both is an included one. None at all is an error."""
    known = engine.catalog.table("files").select("path").union(engine.edges().select("src")).union(engine.edges().select("dst")).distinct()
    given = _named(engine, selection.pins).withColumns({"source": F.lit("pinned"), "rank": F.lit(0)}).unionByName(_named(engine, selection.includes).withColumns({"source": F.lit("explicit"), "rank": F.lit(1)}))
    near = Selection(scopes=[s.strip().removeprefix("./") for s in selection.scopes], excludes=[s.strip().removeprefix("./") for s in selection.excludes])
    rows = given.join(known.withColumn("known", F.lit(True)), "path", "left").withColumn("kept", near.keeps(F.col("path"))).orderBy("rank", "given").collect()  # the user's own list
    warnings = [f"seed {'outside scope/excludes' if r['known'] else 'not found in index'}: {r['given']}" for r in rows if not (r["known"] and r["kept"])]
    good = {r["path"]: r["source"] for r in rows if r["known"] and r["kept"]}
    if not good:
        raise ValueError("no valid seed files found: name some with --include or --pin, or widen the scope")
    return engine.spark.createDataFrame(sorted(good.items()), "path string, source string"), warnings


def around(engine: Engine, selection: Selection, depth: int, limit: int, per_file: int) -> tuple[DataFrame, list[str]]:
    """Blocks of the seeds and of the files within depth of them in the dependency graph, and warnings."""
    if limit <= 0:
        raise ValueError("the limit of files must be above 0")
    sources, warnings = seeds(engine, selection)
    n = sources.count()
    if n > limit:
        warnings.append(f"seed count {n} exceeds limit {limit}; neighbors omitted")
    near = Selection(scopes=[s.strip().removeprefix("./") for s in selection.scopes], excludes=[s.strip().removeprefix("./") for s in selection.excludes])
    chosen = pinned(topology.select_files(engine.edges(), sources, depth, limit, near.keeps(F.col("path"))))
    blocks = pinned(topology.blocks(_chunks(engine), chosen, sources, per_file))
    if blocks.isEmpty():
        raise ValueError("no chunks found for the selected files")
    return blocks, warnings


def overview(engine: Engine) -> dict:
    files, c = engine.catalog.table("files").select("path"), engine.catalog
    stack = [r["t"] for r in files.select(F.explode(P.technologies(F.col("path"))).alias("t")).distinct().orderBy("t").collect()]
    name = c.noted("root", "").rstrip("/").rsplit("/", 1)[-1] or "repo"
    if files.isEmpty():
        return {"name": name, "tech_stack": stack, "summary": []}
    rows = render.summary(files, engine.edges(), c.table("file_commit_edges").select(F.col("file_path").alias("path"), "commit_id"), c.table("file_cochange_edges"))
    return {"name": name, "tech_stack": stack, "summary": [r["line"] for r in render.repo_tree(rows).orderBy("line_no").collect()]}


def prompt(engine: Engine, task: str, selection: Selection | None = None, sections: set[str] | None = None, max_tokens: int = 0, reserved: int = 0, tokenizer: str = "", by_topology: bool = False, depth: int = 1, files: int = 25, per_file: int = 5) -> str:
    """The Markdown for a task. max_tokens 0: as many as the embedder's context holds."""
    selection = selection or Selection()
    if unknown := set(sections or ()) - set(SECTIONS):
        raise ValueError(f"no such section: {', '.join(sorted(unknown))}")
    if by_topology:
        blocks, warnings = around(engine, selection, depth, files, per_file)
        most = files * max(1, per_file)
    else:
        blocks, warnings = retrieved(engine, task, selection)
        most = engine.config.search.limit
    count = providers.counter(tokenizer or engine.config.prompt.tokenizer)
    rows = pinned(assembly.budget(blocks, max_tokens or engine.config.embedding.context_length, None, most, reserved, count))
    chosen = rows.where("id is not null").drop("warning")  # at most `most` rows
    own = chosen.select("path").distinct()
    of_files = lambda t: t.join(F.broadcast(own), "path", "left_semi")
    symbols = of_files(engine.catalog.table("symbols").select(F.col("file_path").alias("path"), "name", "start_byte", "end_byte"))
    languages = of_files(engine.catalog.table("files").select("path", F.nullif(F.col("primary_language"), F.lit("")).alias("language")))
    rich = assembly.enrich(chosen, symbols, languages)
    shown = rich.join(chosen.select("id", "place"), "id").select("place", "source", assembly.render({c: F.col(c) for c in rich.columns}).alias("markdown")).orderBy("place").collect()
    warnings += _warned(rows.where("warning is not null").orderBy("place"))
    main = [r["markdown"] for r in shown if r["source"] != "expanded"]
    return render.prompt(main, overview(engine), warnings, task, sections, [r["markdown"] for r in shown if r["source"] == "expanded"])
