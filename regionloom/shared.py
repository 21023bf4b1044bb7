"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="regionloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Owner:
    """The paths that one piece of work has made in the shared folder."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def clear(self, spark: SparkSession) -> None:
        """Deletes them; results that read them end with them."""
        while self.paths:
            remove(spark, self.paths.pop())


#: The owner of each thread's work; plain, as this module is shipped to workers by value.
_owners: dict[int, Owner] = {}
_process = Owner()


def _owner() -> Owner:
    return _owners.get(threading.get_ident(), _process)


@contextlib.contextmanager
def owned() -> Iterator[Owner]:
    """What this thread makes inside belongs to the owner given, whatever other threads make."""
    me, mine = threading.get_ident(), Owner()
    before = _owners.get(me)
    _owners[me] = mine
    try:
        yield mine
    finally:
        if before is None:
            del _owners[me]
        else:
            _owners[me] = before


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, held by the current owner."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _owner().paths.append(path)
    return path


def written_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and its path: cuts the lineage and outlives lost executors."""
    path = scratch(df.sparkSession, tag)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path), path


def written(df: DataFrame, tag: str) -> DataFrame:
    return written_at(df, tag)[0]


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of whatever store ``path`` names."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    store, there = hadoop(spark, path)
    return store.exists(there)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of whatever store it names."""
    store, there = hadoop(spark, path)
    store.delete(there, True)


def release(spark: SparkSession, path: str) -> None:
    """Deletes one path that nothing reads any more, and lets its owner forget it."""
    for owner in (_owner(), _process):
        if path in owner.paths:
            owner.paths.remove(path)
    remove(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that has been made outside an owner of its own."""
    _owner().clear(spark)


#: Input up to which rows may be dealt anew: more than that comes in enough row groups by itself.
_SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its input is small: one row group is one task, however much each row costs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= _SMALL else df
