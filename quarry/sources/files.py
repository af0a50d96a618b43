"""Files of a source tree, from any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 5_242_880


def read_files(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, size, text, content_hash) of the files under root; larger and binary ones are left out. Sizes filter before contents are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= most_bytes)
    text = F.col("content").cast("string")
    tail = root.split(":", 1)[-1].strip("/") + "/"
    at = F.instr("path", tail)
    below = F.when(at > 0, F.substring(F.col("path"), at + len(tail), F.lit(1 << 30))).otherwise(F.col("path"))
    return rows.where(F.is_valid_utf8(text)).select(below.alias("path"), F.col("length").alias("size"), text.alias("text"), F.sha2("content", 256).alias("content_hash"))
