"""What the operators share: the shared folder, written tables, sizes."""

from __future__ import annotations

import contextlib
import math
import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import clear, hadoop, release, remove, scratch, shared_dir, written, written_at

__all__ = ["clear", "hadoop", "partitions_for", "release", "remove", "scratch", "settings", "shared_dir", "uniform", "word_count", "worker_cache", "written", "written_at"]

#: Words are runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots as two underscores) for what runs inside; as they were after."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """How many partitions give about ``bytes_each`` of the plan's estimated input, at least the session's number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a plan without statistics says "as large as can be", scaled by its columns; then the session's number holds
    return least if size >= 1 << 55 else max(least, math.ceil(size / bytes_each))


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker; code shipped by value has no module globals that do."""
    return sys.modules.setdefault("_regionloom_worker", types.ModuleType("_regionloom_worker")).__dict__


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))
