"""SimHash near-duplicates by a grid join on segment bit counts.

A fingerprint has 64 bits, one for each of the sums over the XXH64 hashes of a
text's 4-word shingles (ASCII letters lower-cased).  Two texts link if their
fingerprints differ in 4 bits or fewer.

Embedding: a fingerprint is cut into 32 segments of 2 bits and mapped to the
vector of their bit counts.  The Manhattan distance of two vectors is at most
the Hamming distance of the fingerprints, so a link has Manhattan distance 4 or
less.  The vector is cut into 8 axes of 4 segments.  A budget of 4 leaves at
least 4 of 8 axes without a share, so linked vectors lie in one cell of the
grid over some 4 axes: each vector goes to its cell on each of the 70 choices
of 4 axes (a range join whose range is spent).  Rows of a cell are compared by
Manhattan distance first and then exactly.

Only distinct fingerprints are joined; copies share one.  A cell is not
expanded into pairs: it is walked breadth first, each row removing all that it
reaches, and gives one link for each member.  So a dense cell costs little more
than its size, and what is sent on grows with the rows, not with their square.

Defined cases: null and blank texts have fingerprint zero and are linked like
others; texts with fewer than four words have one shingle, the whole; null
doc_ids are never a component's name unless it has no other; an empty table
gives no rows; other columns are not read, and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import HEAVY, cells, deal
from .common import partitions_for, written
from .components import components

SHINGLE = 4
SEED = 42
MOST = 4
_STEP = 1 << 16
CELL_BYTES = 4 << 20


def fingerprint(text: str | None) -> int:
    """The 64 bits of a text as a signed number."""
    import xxhash

    # bytes.lower and bytes.split know ASCII letters and the six ASCII white spaces only
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    k = min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    spans = list(zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(spans), _STEP):
        h = np.array([digest(line[a:b], SEED) for a, b in spans[i : i + _STEP]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp of every row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id bigint, fp bigint")


def _counts(fp: np.ndarray) -> np.ndarray:
    """The vector of bit counts of 32 segments, in 2 bits each."""
    x = fp.view(np.uint64)
    return x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))


def _manhattan(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of packed vectors: counts 0, 1, 2 as unary 00, 01, 11 make it a number of unequal bits."""
    unary = lambda v: v | (v >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return np.bitwise_count(unary(p) ^ unary(q))


def _hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    # as unsigned: the count of a negative number is that of its absolute value
    return np.bitwise_count((x ^ y).view(np.uint64))


def _stars(fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """The linked groups among the distinct fingerprints of a cell: (members, least)."""
    left = fp
    while len(left) > 1:
        group, reach, left = [left[:1]], list(left[:1]), left[1:]
        while reach and len(left):
            one = reach.pop()
            near = _manhattan(_counts(left), _counts(np.array([one]))) <= most
            near[near] = _hamming(left[near], one) <= most
            if near.any():
                group.append(left[near])
                reach.extend(left[near])
                left = left[~near]
        members = np.concatenate(group)
        if len(members) > 1:
            yield members, int(members.min())


def links(distinct: DataFrame, most: int = MOST, heavy: int = HEAVY) -> DataFrame:
    """(a, b) that connect all fingerprints of column ``fp`` that differ in ``most`` bits or fewer, by way of one another."""
    if most > 4:
        raise ValueError("the grid is made for 4 bits")
    masks = [sum(0xFF << 8 * i for i in axes) for axes in combinations(range(8), 4)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    low, high = "(fp & 6148914691236517205L)", "(shiftrightunsigned(fp, 1) & 6148914691236517205L)"
    counts = F.expr(f"({low} ^ {high}) | shiftleft({low} & {high}, 1)")
    grid = F.array(*[F.struct(F.lit(i).cast("int").alias("axes"), F.lit(signed(m)).alias("mask")) for i, m in enumerate(masks)])
    celled = lambda d: d.select("fp", counts.alias("counts"), F.explode(grid).alias("g")).select(F.col("g.axes").alias("axes"), F.col("counts").bitwiseAND(F.col("g.mask")).alias("cell"), "fp")
    rows = deal(distinct, celled, "fp", ["axes", "cell"], heavy)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, fp), begins, ends in cells(batches, 3):
            a, b = [], []
            two = ends - begins == 2
            x, y = fp[begins[two]], fp[begins[two] + 1]
            near = _manhattan(_counts(x), _counts(y)) <= most
            near[near] = _hamming(x[near], y[near]) <= most
            a.append(np.maximum(x[near], y[near]))
            b.append(np.minimum(x[near], y[near]))
            for i, j in zip(begins[~two].tolist(), ends[~two].tolist(), strict=True):
                for members, least in _stars(fp[i:j], most):
                    others = members[members != least]
                    a.append(others)
                    b.append(np.full(len(others), least))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])

    # 70 rows of about 24 bytes for each fingerprint
    n = partitions_for(distinct, CELL_BYTES // 100)
    cell = ["axes", "cell", "part"]
    dealt = rows.select(*cell, "fp").repartition(n, *cell).sortWithinPartitions(*cell)
    return dealt.mapInArrow(joined, "a bigint, b bigint").distinct()


def _rooted(prints: DataFrame, most: int) -> DataFrame:
    """fp, least (doc_id), root of every distinct fingerprint of (doc_id, fp)."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(distinct, most))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return written(rooted, "roots")


def near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    prints = written(fingerprints(docs), "doc-fingerprints")
    rooted = _rooted(prints, most)
    found = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, most: int = MOST) -> DataFrame:
    """``docs`` with one row of each group, the one with the least doc_id; their columns are kept."""

    @F.pandas_udf("bigint")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t) for t in batch], dtype="int64")

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), of(docs["text"]).alias("fp"))
    rows = written(rows.withColumn("key", F.xxhash64("doc_id", "fp")), "printed")
    rooted = _rooted(rows.select("doc_id", "fp"), most)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("v")).select(F.col("v.least").alias("id"), F.col("v.fp").alias("print"))
    first = first.withColumn("key", F.xxhash64("id", "print"))
    both = rows.join(first, (rows["key"] == first["key"]) & rows["doc_id"].eqNullSafe(first["id"]) & (rows["fp"] == first["print"]), "left_semi")
    return both.dropDuplicates(["key", "doc_id", "fp"]).select("row.*")
