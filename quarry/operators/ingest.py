"""Files, chunks and their upkeep: chunking, change detection, upserts, pruning, cascades.

Tables are DataFrames; each function gives the new state of a table, to be written beside the old
one and swapped in. Joins are on path or id, so a lakehouse table bucketed by path needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(files: DataFrame, most_bytes: int) -> DataFrame:
    """(path, text) to (path, size, content_hash), without larger files."""
    return files.select("path", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("content_hash")).where(F.col("size") <= most_bytes)


def chunk_lines(files: DataFrame, size: int, overlap: float) -> DataFrame:
    """(path, text) to windows of `size` lines that share a part of `overlap`: one row for each chunk, with line and byte spans."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be at least 0 and below 1")
    step = max(1, round(size * (1 - overlap)))
    lines = files.select("path", F.split("text", "\n", -1).alias("lines")).select("path", "lines", F.size("lines").alias("n"))
    # a window that holds nothing new after the one before it is left out
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.when(F.col("n") <= size, F.lit(0)).otherwise(F.ceil((F.col("n") - size) / step).cast("int") * step)), F.lit(step))
    # window i begins i steps in, so the bytes before it are those of the i steps before it
    steps = F.transform(starts, lambda at: (F.octet_length(F.array_join(F.slice("lines", at + 1, step), "\n")) + 1).cast("long"))
    rows = lines.select("path", "lines", "n", steps.alias("steps"), F.posexplode(starts).alias("ordinal", "at"))
    text = F.array_join(F.slice("lines", F.col("at") + 1, size), "\n")
    before = F.aggregate(F.slice("steps", F.lit(1), F.col("ordinal")), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("path", F.col("ordinal").cast("int"), (F.col("at") + 1).cast("int").alias("start_line"), F.least(F.col("at") + size, "n").cast("int").alias("end_line"), before.cast("long").alias("start_byte"), text.alias("text")).withColumn("end_byte", F.col("start_byte") + F.octet_length("text"))


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)


def existing_hashes(files: DataFrame) -> DataFrame:
    return files.where(F.col("content_hash").isNotNull() & (F.octet_length("content_hash") == 32)).select("path", "content_hash")


def changes(known: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status) of known and found (path, content_hash)."""
    k, f = known.select("path", F.col("content_hash").alias("was"), F.lit(True).alias("k")), found.select("path", F.col("content_hash").alias("is"), F.lit(True).alias("f"))
    status = F.when(F.col("k").isNull(), "new").when(F.col("f").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("is")), "unchanged").otherwise("changed")
    return k.join(f, "path", "full_outer").select("path", status.alias("status"))


def upsert_files(known: DataFrame, found: DataFrame) -> DataFrame:
    """Files after an upsert; updated says whether a row was written: only if it is new or its hash, size or language differs."""
    cols = ("content_hash", "size", "primary_language")
    k = known.select("path", *[F.col(c).alias(f"k_{c}") for c in cols], F.lit(True).alias("k"))
    f = found.select("path", *[F.col(c).alias(f"f_{c}") for c in cols], F.lit(True).alias("f"))
    empty = F.lit("")
    differs = F.col("k_content_hash").isNull() | ~F.col("k_content_hash").eqNullSafe(F.col("f_content_hash")) | (F.col("k_size") != F.col("f_size")) | (F.coalesce("k_primary_language", empty) != F.coalesce("f_primary_language", empty))
    write = F.col("f").isNotNull() & (F.col("k").isNull() | differs)
    return k.join(f, "path", "full_outer").select("path", *[F.when(write, F.col(f"f_{c}")).otherwise(F.col(f"k_{c}")).alias(c) for c in cols], F.coalesce(write, F.lit(False)).alias("updated"))


def upsert_latest(known: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """Rows of found replace those of known with the same key."""
    return known.join(found.select(key), key, "left_anti").unionByName(found)


def find_chunk_ids(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(kind, chunk_hash, ...) with the id of a chunk of that kind and hash, wherever it stands, or null."""
    ids = chunks.groupBy("kind", "chunk_hash").agg(F.min("id").alias("found_id"))
    return wanted.join(ids, ["kind", "chunk_hash"], "left")


def reuse_embeddings(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """incoming chunks with the embedding of a known chunk of the same kind and hash (the one of least id), else null: those are yet to be embedded."""
    held = known.groupBy("kind", "chunk_hash").agg(F.min("id").alias("reused_from"), F.min_by("embedding", "id").alias("embedding"))
    return incoming.join(held, ["kind", "chunk_hash"], "left")


def prune_chunks(chunks: DataFrame, files: DataFrame, keep: DataFrame) -> DataFrame:
    """chunks without those of files(path) that keep(id) does not list."""
    return chunks.join(files.select("path"), "path", "left_anti").unionByName(chunks.join(files.select("path"), "path", "left_semi").join(keep.select("id"), "id", "left_semi").select(*chunks.columns))


def replace_rows(table: DataFrame, files: DataFrame, rows: DataFrame, column: str = "path") -> DataFrame:
    """table with all rows of the files(path) replaced by rows."""
    return table.join(files.select(F.col("path").alias("_p")), F.col(column) == F.col("_p"), "left_anti").unionByName(rows)


def delete_files(tables: dict[str, tuple[DataFrame, list[str]]], files: DataFrame) -> dict[str, DataFrame]:
    """Each table without rows that name one of files(path) in any of its columns of paths."""
    out = {}
    for name, (table, columns) in tables.items():
        for c in columns:
            table = table.join(files.select(F.col("path").alias("_p")), F.col(c) == F.col("_p"), "left_anti")
        out[name] = table
    return out


def ordinals(chunks: DataFrame) -> DataFrame:
    order = Window.partitionBy("path").orderBy("start_byte", "id")
    return chunks.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int"))


def incomplete(events: DataFrame) -> DataFrame:
    """Files that have content events but no end."""
    return events.groupBy("path").agg(F.max((F.col("event_type") == "end").cast("int")).alias("ended"), F.count("*").alias("n_events")).where("ended = 0").select("path", "n_events")


def extract_symbols(chunks: DataFrame, definition: str, reference: str) -> DataFrame:
    """(id, path, name, kind, start_byte, end_byte): names that patterns find in a chunk's text, with the chunk's span."""
    found = lambda pattern, kind: F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))
    rows = chunks.select("path", "start_byte", "end_byte", F.explode(F.concat(found(definition, "definition"), found(reference, "reference"))).alias("s"))
    return rows.select(stable_id(F.col("path"), F.col("s.kind"), F.col("start_byte"), F.col("end_byte"), F.col("s.name")).alias("id"), "path", F.col("s.name").alias("name"), F.col("s.kind").alias("kind"), "start_byte", "end_byte")
