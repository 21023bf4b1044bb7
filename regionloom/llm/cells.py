"""The cells of a grid join: dealing them, heavy ones in parts, and reading them sorted, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: One item in so many is dealt beforehand, to find the heavy cells.
SAMPLE = 128
#: Rows of a cell, about, above which it is dealt in parts.
HEAVY = 1 << 16


def deal(items: DataFrame, made: Callable[[DataFrame], DataFrame], key: str, cell: list[str], heavy: int = HEAVY, sample: int = SAMPLE) -> DataFrame:
    """``made(items)``, rows of cells, with ``part``, ``own`` and ``groups``: a cell of more than ``heavy`` rows is dealt in parts.

    Its members are hashed into groups of about ``heavy``; a part is a pair of
    groups, so any two members meet in some part and no part holds more than two
    groups; ``of_part`` names the one part that a pair of members belongs to.  The sample only says which cells to part: one that it misses is
    compared whole, and the result is the same.
    """
    some = items.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(sample)) == 0)
    counts = made(some).groupBy(*cell).agg((F.count("*") * sample).alias("n")).where(F.col("n") > heavy)
    found = written(counts.select(*cell, F.ceil(F.col("n") / heavy).alias("groups")), "heavy-cells")
    rows = made(items)
    if found.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long")).withColumn("own", F.lit(0).cast("long")).withColumn("groups", F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64(key, F.lit(29)), F.col("groups"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1), lambda j: F.least(own, j) * F.col("groups") + F.greatest(own, j))
    parts = F.when(F.col("groups").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
    rows = rows.join(found, cell, "left").withColumn("part", F.explode(parts)).withColumn("own", F.coalesce(own, F.lit(0)))
    return rows.withColumn("groups", F.coalesce("groups", F.lit(1)))


def of_part(own: np.ndarray, other: np.ndarray, groups: int) -> np.ndarray:
    """The part that pairs of members of these groups belong to, among all in which they meet."""
    return np.minimum(own, other) * groups + np.maximum(own, other)


def cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(columns, begins, ends) of cells with two rows or more.

    The first ``keys`` columns name the cell.  Rows come sorted by them; a cell
    may go on over batches and is given once, whole.
    """
    kept: list[list[np.ndarray]] = []

    def given(columns: list[np.ndarray], cuts: np.ndarray) -> Iterator:
        begins, ends = cuts[:-1], cuts[1:]
        many = ends - begins > 1
        if many.any():
            yield columns, begins[many], ends[many]

    for batch in batches:
        columns = [_column(batch.column(i)) for i in range(batch.num_columns)]
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in columns[:keys]:
            new[1:] |= c[1:] != c[:-1]
        new[0] = not kept or any(k[-1] != c[0] for k, c in zip(kept[-1][:keys], columns[:keys], strict=True))
        cuts = np.flatnonzero(new)
        if not len(cuts):
            kept.append(columns)
            continue
        if kept:
            before = [np.concatenate(c) for c in zip(*kept, [x[: cuts[0]] for x in columns], strict=True)]
            yield from given(before, np.array([0, len(before[0])]))
        yield from given(columns, cuts)
        kept = [[c[cuts[-1] :] for c in columns]]
    if kept:
        last = [np.concatenate(c) for c in zip(*kept, strict=True)]
        yield from given(last, np.array([0, len(last[0])]))


def _column(column: pa.Array) -> np.ndarray:
    """A column of numbers, or of equally long binaries as rows of float32."""
    if pa.types.is_binary(column.type):
        width = len(column[0].as_py()) // 4
        data = np.frombuffer(column.buffers()[2], "<f4")
        return data[: (column.offset + len(column)) * width].reshape(-1, width)[column.offset :]
    return column.to_numpy(zero_copy_only=False)
