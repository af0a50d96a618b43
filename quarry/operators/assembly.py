"""Context assembly: tiers, expansion, order, budget, trimming, enrichment."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..shipping import ship

#: Tiers of blocks in order, and the reason given for each.
TIERS = {"explicit": "explicit_include", "pinned": "pinned", "primary": "retrieval", "expanded": "expanded_neighbor"}


def tier_rank(source: Column) -> Column:
    return F.array_position(F.lit(list(TIERS)), source) - 1


def reason(source: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), source)


def first_chunks(chunks: DataFrame, files: DataFrame, n: int) -> DataFrame:
    """The first n chunks of each of files(path); the window keeps n rows a file before its shuffle's sort ends."""
    order = Window.partitionBy("path").orderBy("ordinal")
    return chunks.join(files.select("path").distinct(), "path", "left_semi").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def tiers(chunks: DataFrame, includes: DataFrame, pins: DataFrame, hits: DataFrame, per_file: int) -> DataFrame:
    """Blocks of included and pinned files (score 1) and of hits(id, score), with source."""
    own = lambda files, name: first_chunks(chunks, files, max(1, per_file)).withColumns({"score": F.lit(1.0), "source": F.lit(name)})
    found = chunks.join(hits.select("id", "score"), "id").withColumn("source", F.lit("primary"))
    return own(includes, "explicit").unionByName(own(pins, "pinned")).unionByName(found)


def missing(wanted: DataFrame, files: DataFrame, label: str) -> DataFrame:
    return wanted.join(files.select("path"), "path", "left_anti").select(F.format_string(f"{label} not found: %s", "path").alias("warning"))


def in_order(blocks: DataFrame) -> list[Column]:
    return [tier_rank(F.col("source")), F.desc("score"), F.col("path"), F.col("start_byte")]


def first_of_each(blocks: DataFrame) -> DataFrame:
    """Of blocks with one id the first in order stays."""
    order = Window.partitionBy("id").orderBy(*in_order(blocks))
    return blocks.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def trim_text(text: str, most: int, size: Callable[[str], int]) -> tuple[str, int] | None:
    """The longest head of whole lines of at most that size, and its lines; None if not one fits."""
    if most <= 0:
        return None
    kept, lines = "", 0
    for i, line in enumerate(text.split("\n") if not text.endswith("\n") else text[:-1].split("\n")):
        line = line.removesuffix("\r")
        longer = f"{kept}\n{line}" if kept else line
        if size(longer) > most:
            break
        kept, lines = longer, i + 1
    return (kept, lines) if kept else None


def trimmed_bytes(blocks: DataFrame, most: int) -> DataFrame:
    """blocks cut to their longest head of whole lines of at most `most` bytes, as columns; those of which nothing fits go."""
    if most <= 0:
        return blocks.where("false")
    data = F.col("text").cast("binary")
    # a line that ends within the limit is followed by a break at most one byte beyond it
    head = F.substring(data, 1, most + 1).cast("string")
    room = F.octet_length(head) - F.octet_length(F.substring_index(head, "\n", -1)) - 1
    cut = F.when(F.octet_length("text") <= most, F.col("text")).when(room > 0, F.substring(data, F.lit(1), room).cast("string"))
    out = blocks.withColumn("text", cut).where("text <> ''")
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    return out.withColumns({"end_line": (F.col("start_line") + breaks).cast("int"), "end_byte": F.col("start_byte") + F.octet_length("text")})


def budget(blocks: DataFrame, max_tokens: int | None, max_bytes: int | None, max_blocks: int, reserved: int = 0, count: Callable[[str], int] = len, request: str | None = None) -> DataFrame:
    """Blocks in order until a budget is full: one pass that skips what is too large if expanded, and trims it if not.

    The fold depends on all rows before, so one task folds one request (the column named, or all
    rows); requests run beside each other. A request's blocks are what its tiers let through, each
    bounded by a limit of its own.
    """
    ship(blocks.sparkSession)
    schema = "request string, place int, id string, path string, source string, score double, start_line int, end_line int, start_byte long, end_byte long, text string, warning string"
    room = None if max_tokens is None else max(0, max_tokens - reserved)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rank = {s: i for i, s in enumerate(TIERS)}
        group = group.assign(_r=group.source.map(rank)).sort_values(["_r", "score", "path", "start_byte"], ascending=[True, False, True, True], kind="stable")
        rows, seen, tokens, size = [], set(), 0, 0
        for b in group.to_dict("records"):
            if b["id"] in seen:
                continue
            seen.add(b["id"])
            own, why = count(b["text"]), None
            for limit, used, measure, name in ((room, tokens, count, "token"), (max_bytes, size, lambda t: len(t.encode()), "byte")):
                if limit is None or used + measure(b["text"]) <= limit:
                    continue
                cut = None if b["source"] == "expanded" else trim_text(b["text"], limit - used, measure)
                if cut is None:
                    why = f"{b['source']} dropped due to {name} budget: {b['path']}" if b["source"] in ("explicit", "pinned") else ""
                    break
                b["text"], n = cut
                b["end_line"], b["end_byte"] = b["start_line"] + n - 1, b["start_byte"] + len(b["text"].encode())
                own = count(b["text"])
            base = {"request": b["request"], "place": len(rows) + 1}
            if why is not None:
                if why:
                    rows.append(base | {"warning": why})
                continue
            tokens, size = tokens + own, size + len(b["text"].encode())
            rows.append(base | {k: b[k] for k in ("id", "path", "source", "score", "start_line", "end_line", "start_byte", "end_byte", "text")})
            if sum(1 for r in rows if "id" in r) >= max_blocks:
                break
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
        kinds = {"string": object, "int": "Int32", "long": "Int64", "double": "float64"}
        return out.astype({c: kinds[k] for c, k in (x.split() for x in schema.split(", "))})

    # an expanded block is never trimmed, so one that is larger than the whole budget goes before the shuffle to the fold
    too_large = F.lit(False) if max_bytes is None else F.octet_length("text") > max_bytes
    if room is not None and count is len:
        too_large = too_large | (F.char_length("text") > room)
    rows = first_of_each(blocks).where(~((F.col("source") == "expanded") & too_large)).select((F.col(request).cast("string") if request else F.lit("")).alias("request"), "id", "path", "source", F.col("score").cast("double"), "start_line", "end_line", "start_byte", "end_byte", "text")
    return rows.groupBy("request").applyInPandas(fold, schema)


def symbols_in(blocks: DataFrame, symbols: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """(block_id, name, start_byte, end_byte) of symbols that overlap blocks of their file, half open.

    Both sides spread over buckets of bytes, so one large file is no single join key; each pair is
    kept in its first common bucket.
    """
    spread = lambda df, a, b: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / bucket))))
    s = spread(symbols.select("path", "name", F.col("start_byte").alias("s0"), F.col("end_byte").alias("s1")), "s0", "s1")
    b = spread(blocks.select("path", F.col("id").alias("block_id"), F.col("start_byte").alias("b0"), F.col("end_byte").alias("b1")), "b0", "b1")
    hit = b.join(s, ["path", "cell"]).where((F.col("s0") < F.col("b1")) & (F.col("s1") > F.col("b0")) & (F.col("cell") == F.floor(F.greatest("s0", "b0") / bucket)))
    return hit.select("block_id", "name", F.col("s0").alias("start_byte"), F.col("s1").alias("end_byte"))


def enrich(blocks: DataFrame, symbols: DataFrame, languages: DataFrame, root: str = "") -> DataFrame:
    """blocks with their symbols' sorted names, language (default text), relevance and display path."""
    names = symbols_in(blocks, symbols).groupBy(F.col("block_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("symbols"))
    return blocks.join(names, "id", "left").join(languages.select("path", "language"), "path", "left").select("id", P.display(F.col("path"), root).alias("path"), "source", F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0)).alias("relevance"), F.greatest("start_line", F.lit(1)).alias("start_line"), F.greatest("end_line", F.lit(1)).alias("end_line"), F.coalesce("language", F.lit("text")).alias("language"), F.coalesce("symbols", F.lit("")).alias("symbols"), "text")


def render(block: dict[str, Column]) -> Column:
    """The Markdown of one enriched block."""
    b = block
    head = F.format_string("<BLOCK>\npath: %s\nLines: %d-%d\nrelevance: %.4f\nsource: %s\nreason: %s\nlanguage: %s\n", b["path"], b["start_line"], b["end_line"], b["relevance"], b["source"], reason(b["source"]), b["language"])
    names = F.when(b["symbols"] != "", F.concat(F.lit("symbols: "), b["symbols"], F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(head, names, F.lit("```"), P.fence(b["language"]), F.lit("\n"), b["text"], F.lit("\n```\n</BLOCK>"))


def token_batches(items: DataFrame, max_items: int, max_tokens: int) -> DataFrame:
    """(lane, id, batch): items(lane, place, id, tokens) of each lane in order, a new batch where the next item would be one too many or exceed the tokens; a larger item goes alone."""
    ship(items.sparkSession)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        batch, n, total, out = 0, 0, 0, []
        for t in group.sort_values(["place", "id"]).tokens:
            if n and (n >= max_items or total + t > max_tokens):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + t
            out.append(batch)
        g = group.sort_values(["place", "id"])
        return pd.DataFrame({"lane": g.lane, "id": g.id, "batch": out})

    return items.groupBy("lane").applyInPandas(fold, "lane long, id long, batch int")
