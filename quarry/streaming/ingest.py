"""Files arriving as a stream: chunks are written once a file's end has come."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..shipping import ship

EVENTS = "path string, event_type string, ordinal int, text string"


def events(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files of events as they appear in a folder: content chunks, an end for each file, or a delete."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def complete_files(stream: DataFrame) -> DataFrame:
    """(path, event_type, n_chunks, text): a file's chunks in order, once, when its end has come; a delete drops what is pending and passes on.

    The state of a file is its pending chunks, which go with its end or its delete.
    """
    ship(stream.sparkSession)

    def step(key, frames, state):
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        done = None
        for f in frames:
            for e in f.sort_values("ordinal", kind="stable").itertuples(index=False):
                if e.event_type == "content":
                    held[int(e.ordinal)] = e.text
                elif e.event_type == "delete":
                    held, done = {}, "delete"
                else:
                    done = "end"
        if done is None:
            state.update((list(held), list(held.values())))
            return
        if state.exists:
            state.remove()
        yield pd.DataFrame({"path": [key[0]], "event_type": [done], "n_chunks": [len(held)], "text": ["\n".join(held[i] for i in sorted(held))]})

    return stream.groupBy("path").applyInPandasWithState(step, "path string, event_type string, n_chunks int, text string", "ordinals array<int>, texts array<string>", "append", "NoTimeout")


def run(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], lines: int = 60, overlap: float = 0.2):
    """Starts the query; each batch of completed files reaches the sink as chunks with stable ids. A replayed batch has the same ids."""

    def put(batch: DataFrame, number: int) -> None:
        files = batch.where("event_type = 'end'")
        chunks = ingest.chunk_lines(files.select("path", "text"), lines, overlap)
        sink(chunks.withColumn("id", ingest.stable_id(F.col("path"), F.lit("text"), F.col("start_byte"), F.col("end_byte"), F.sha2("text", 256))), number)

    return complete_files(stream).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).start()
