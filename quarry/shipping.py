"""Sends this package to the executors, so that their Python workers can import it wherever they run."""

from __future__ import annotations

import contextlib
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="package"), "quarry_package.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(top)))
    sc.addPyFile(to)
    _SENT.add(sc.applicationId)


def _give_back() -> None:
    """Returns what a Python worker has freed to the system, so that a reused worker does not keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps its own way
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)

    def whole(batches):
        yield from run(batches)
        _give_back()

    return df.mapInArrow(whole, schema)
