"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c have squared distance 2 - 2c.  A fixed random
rotation spreads it evenly; the rotated vector is cut into blocks of 8
coordinates, and of two vectors within a squared distance D at least one block
is within its share, D by the block's part of the coordinates.  Each block is a
range join on a grid: over its first 4 coordinates a vector goes to every cell
that it comes within half the radius of, so two vectors within the radius meet
in a cell.  There the blocks' distances are compared (the numbers, not the
rows), and the union of what all blocks let through is verified on the original
vectors in double precision.

Equal vectors of a label are one class with a count; links between classes give
links of vectors by multiplication, and copies are never paired.  A cell that
lets more than ``DENSE`` pairs a member through sends on its members, not pairs:
they are verified within the cell, which gives a count and one link for each.
A pair belongs to the first block that lets it through, and there to one cell and
part of it, so it is counted once.  What is sent on grows with the rows.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and those without a label, link with nothing; vectors of different
lengths do not link; repeated vec_ids are rows of their own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import HEAVY, cells, deal, of_part
from .common import partitions_for, written
from .components import components

COSINE = 0.98
BLOCK = 8
GRID = 4
#: Cell width in radii.
WIDTH = 3.0
#: Rows of a cell that are compared at once, and pairs that are sent on at once.
_PAIRS = 512
_SENT = 1 << 18
#: Pairs a member above which a cell sends on its members instead, if it has more than ``_SMALLEST`` pairs.
DENSE = 8.0
_SMALLEST = 64


def rotation(dim: int) -> np.ndarray:
    """The same random rotation everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(20240229 + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v, np.float64) for v in column.to_pylist()]


def _rotated(classes: DataFrame) -> DataFrame:
    """``classes`` with ``rot``: the rotated unit vector as float32, filled up to whole blocks.

    It is computed once and stored, so that all tasks compare the same numbers.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors, out = _vectors(batch.column("embedding")), [b""] * batch.num_rows
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for dim, rows in by_dim.items():
                x = np.stack([vectors[i] for i in rows])
                # scaled first: squares of very large or small components stay finite
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                x = np.pad(x @ turned.setdefault(dim, rotation(dim)), ((0, 0), (0, -dim % BLOCK))).astype("<f4")
                for i, row in zip(rows, x, strict=True):
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "rot"])

    return classes.mapInArrow(made, classes.withColumn("rot", F.lit(b"")).schema)


def _share(dim: int, block: int, cosine: float) -> float:
    """The squared distance that a block may have, a little more than its part."""
    return (2 - 2 * cosine) * min(BLOCK, dim - BLOCK * block) / dim + 1e-6


def _edges(x: np.ndarray, dim: int, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last grid line of each row's first coordinates: the cells that it comes within half the radius of."""
    radius = np.sqrt(_share(dim, block, cosine)) * (1 + 1e-9)
    x = x[:, : min(GRID, dim - BLOCK * block)].astype(np.float64)
    return tuple(np.floor((x + side * radius / 2) / (WIDTH * radius)).astype(np.int64) for side in (-1, 1))


def _cell(lines: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lines), np.int64)
    for g in range(lines.shape[1]):
        out = out * 4096 + (lines[:, g] + 2048)
    return out


def _square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of a block's rows, added up in one order everywhere."""
    d = x.astype(np.float64) - y.astype(np.float64)
    out = np.zeros(len(d))
    for i in range(BLOCK):
        out += d[:, i] * d[:, i]
    return out


def _dealt(classes: DataFrame, cosine: float) -> DataFrame:
    """(label, dim, block, cell, class, coordinates) of every cell that a block of a vector comes near."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(batch.column("rot").take(pa.array(rows)).to_pylist()), "<f4").reshape(len(rows), -1)
                labels, ids = batch.column("label").to_numpy(zero_copy_only=False)[rows], batch.column("class").to_numpy()[rows]
                for block, first in enumerate(range(0, dim, BLOCK)):
                    part = np.ascontiguousarray(x[:, first : first + BLOCK])
                    low, high = _edges(part, dim, block, cosine)
                    at, cell = np.arange(len(part)), np.zeros(len(part), np.int64)
                    for g in range(low.shape[1]):
                        # a coordinate touches one cell or two
                        n = (high - low)[at, g] + 1
                        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        at, cell = np.repeat(at, n), np.repeat(cell, n)
                        cell = cell * 4096 + (low[at, g] + step + 2048)
                    coordinates = [row.tobytes() for row in part]
                    full = lambda v, t: pa.array(np.full(len(at), v), t)
                    yield pa.RecordBatch.from_arrays([pa.array(labels[at], pa.int64()), full(dim, pa.int32()), full(block, pa.int32()), pa.array(cell, pa.int64()), pa.array(ids[at], pa.int64()), pa.array([coordinates[i] for i in at.tolist()], pa.binary())], ["label", "dim", "block", "cell", "class", "coordinates"])

    return classes.select(F.col("label").cast("long").alias("label"), F.size("embedding").alias("dim"), "class", "rot").mapInArrow(made, "label bigint, dim int, block int, cell bigint, class bigint, coordinates binary")


_CELL = ["dim", "label", "block", "cell"]
_FOUND = "a bigint, b bigint, dim int, label bigint, block int, cell bigint, part bigint, own bigint, groups bigint"


def _near(x: np.ndarray, dim: int, block: int, cell: int, part: int, own: np.ndarray, groups: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (p, q) of the pairs of a cell's rows that the block lets through, some at a time.

    A pair that meets in several cells or parts is given in one of them: the one cell that both rows' first lines name.
    """
    share, wide = _share(dim, block, cosine), x.astype(np.float64)
    low, square = _edges(x, dim, block, cosine)[0], (wide * wide).sum(axis=1)
    for m in range(0, len(x), _PAIRS):
        for k in range(m, len(x), _PAIRS):
            d = square[m : m + _PAIRS, None] + square[None, k : k + _PAIRS] - 2 * wide[m : m + _PAIRS] @ wide[k : k + _PAIRS].T
            p, q = np.nonzero(np.triu(d <= share + 1e-9, 1) if m == k else d <= share + 1e-9)
            p, q = m + p, k + q
            if not len(p):
                continue
            good = _square(x[p], x[q]) <= share
            good[good] = _cell(np.maximum(low[p[good]], low[q[good]])) == cell
            if groups > 1:
                good[good] = of_part(own[p[good]], own[q[good]], groups) == part
            if good.any():
                yield p[good], q[good]


def _compared(classes: DataFrame, cosine: float, heavy: int, dense: float) -> DataFrame:
    """Rows of ``_FOUND``: the pairs of classes that a block lets through, with the block; or, with b null, the members of a cell that has more than ``dense`` such pairs a member."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def made() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            none = columns.pop(1)
            b = pa.array(none, pa.int64(), mask=none < 0)
            schema = [("a", "i8"), ("dim", "i4"), ("label", "i8"), ("block", "i4"), ("cell", "i8"), ("part", "i8"), ("own", "i8"), ("groups", "i8")]
            arrays = [pa.array(c.astype(t)) for c, (_, t) in zip(columns, schema, strict=True)]
            return pa.RecordBatch.from_arrays([arrays[0], b, *arrays[1:]], ["a", "b", *[n for n, _ in schema[1:]]])

        for (dims, labels, blocks, at, part, ids, owns, groups, coordinates), begins, ends in cells(batches, 5):
            for i, j in zip(begins.tolist(), ends.tolist(), strict=True):
                own = ids[i:j]
                name = [int(c[i]) for c in (dims, labels, blocks, at, part)]
                pairs, n = [], 0
                for p, q in _near(coordinates[i:j], name[0], name[2], name[3], name[4], owns[i:j], int(groups[i]), cosine):
                    pairs.append((np.minimum(own[p], own[q]), np.maximum(own[p], own[q])))
                    n += len(p)
                    if n > max(dense * (j - i), _SMALLEST):
                        break
                if n > max(dense * (j - i), _SMALLEST):
                    held.append([own, np.full(j - i, -1), *[np.full(j - i, v) for v in name], owns[i:j], groups[i:j]])
                elif n:
                    a, b = (np.concatenate(c) for c in zip(*pairs, strict=True))
                    held.append([a, b, *[np.full(n, v) for v in name], np.zeros(n, np.int64), np.ones(n, np.int64)])
                if sum(len(h[0]) for h in held) > _SENT:
                    yield made()
        if held:
            yield made()

    dealt = deal(classes, lambda d: _dealt(d, cosine), "class", _CELL, heavy)
    n = partitions_for(classes, 1 << 20)
    dealt = dealt.select(*_CELL, "part", "class", "own", "groups", "coordinates").repartition(n, *_CELL, "part").sortWithinPartitions(*_CELL, "part")
    return dealt.mapInArrow(joined, _FOUND)


def candidates(classes: DataFrame, cosine: float = COSINE, heavy: int = HEAVY) -> DataFrame:
    """(a, b), a < b: all pairs of classes that some block lets through, each once."""
    return _compared(written(_rotated(classes), "rotated"), cosine, heavy, float("inf")).select("a", "b").distinct()


def _cosines(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    x, y = np.stack(x).astype(np.float64), np.stack(y).astype(np.float64)
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def _first_block(x: np.ndarray, y: np.ndarray, dim: int, cosine: float) -> np.ndarray:
    """The first block that lets each pair of rotated vectors through."""
    out = np.full(len(x), -1)
    for block in range(-(-dim // BLOCK)):
        left = np.flatnonzero(out < 0)
        cut = slice(BLOCK * block, BLOCK * block + BLOCK)
        out[left[_square(x[left, cut], y[left, cut]) <= _share(dim, block, cosine)]] = block
    return out


def verified(pairs: DataFrame, classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The pairs whose vectors have the cosine; with a column ``block`` only those whose first block that is."""
    by_block = "block" in pairs.columns
    columns = ["embedding", "rot"] if by_block else ["embedding"]
    side = lambda c: classes.select(F.col("class").alias(c), *[F.col(n).alias(f"{n}_{c}") for n in columns])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # both vectors of a candidate have the same length
            sizes, good = batch.column("embedding_a").value_lengths().to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, bool)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                x, y = (batch.column(f"embedding_{c}").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for c in "ab")
                good[rows] = _cosines(list(x), list(y)) >= cosine
                if by_block:
                    x, y = (np.frombuffer(b"".join(batch.column(f"rot_{c}").take(pa.array(rows)).to_pylist()), "<f4").reshape(len(rows), -1) for c in "ab")
                    good[rows] &= _first_block(x, y, dim, cosine) == batch.column("block").to_numpy()[rows]
            yield batch.select(["a", "b"]).filter(pa.array(good))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *(["block"] if by_block else []), *[f"{n}_{c}" for n in columns for c in "ab"])
    return both.mapInArrow(kept, "a bigint, b bigint")


def _joined(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Adds links to ``root``, which names the least place that each is linked with so far."""
    while True:
        a, b = root[p], root[q]
        if (a == b).all():
            return
        least = np.minimum(a, b)
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        while (root != root[root]).any():
            root[:] = root[root]


def _counted(members: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """(class, others, root) of the members of dense cells: vectors linked there and a link that joins them, never the pairs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(rows: list[dict]) -> pa.RecordBatch | None:
            dim, block = rows[0]["dim"], rows[0]["block"]
            rot = np.frombuffer(b"".join(r["rot"] for r in rows), "<f4").reshape(len(rows), -1)
            x = np.stack([np.asarray(r["embedding"], np.float64) for r in rows])
            x /= np.abs(x).max(axis=1, keepdims=True)
            long = (x * x).sum(axis=1)
            own, copies = np.array([r["own"] for r in rows]), np.array([r["copies"] for r in rows], np.int64)
            others, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
            part = np.ascontiguousarray(rot[:, BLOCK * block : BLOCK * block + BLOCK])
            for p, q in _near(part, dim, block, rows[0]["cell"], rows[0]["part"], own, rows[0]["groups"], cosine):
                good = (x[p] * x[q]).sum(axis=1) / np.sqrt(long[p] * long[q]) >= cosine
                p, q = p[good], q[good]
                good = _first_block(rot[p], rot[q], dim, cosine) == block
                p, q = p[good], q[good]
                np.add.at(others, p, copies[q])
                np.add.at(others, q, copies[p])
                _joined(root, p, q)
            hit = np.flatnonzero(others)
            if len(hit):
                names = np.array([r["a"] for r in rows], np.int64)
                return pa.RecordBatch.from_arrays([pa.array(names[hit]), pa.array(others[hit]), pa.array(names[root[hit]])], ["class", "others", "root"])
            return None

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(held[0][c] != row[c] for c in (*_CELL, "part")):
                    if (out := one(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := one(held)) is not None:
            yield out

    both = members.drop("b").join(classes.select(F.col("class").alias("a"), "embedding", "rot", "copies"), "a")
    both = both.repartition(*_CELL, "part").sortWithinPartitions(*_CELL, "part", "a")
    return both.mapInArrow(counted, "class bigint, others bigint, root bigint")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, heavy: int = HEAVY, dense: float = DENSE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", "embedding", usable.alias("usable"))
    # a hash ahead of the vector makes sorting by it cheap
    good = rows.where("usable").select("vec_id", "label", "embedding", F.xxhash64("label", "embedding").alias("key"))
    classes = good.groupBy("key", "label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("class", F.monotonically_increasing_id())
    classes = written(_rotated(written(classes, "classes")), "classes-rotated")
    found = written(_compared(classes, cosine, heavy, dense), "vector-candidates")
    # a pair stands with the first block that lets it through: in a sparse cell as a pair, in a dense one within the cell
    sparse = found.where("b is not null").groupBy("a", "b").agg(F.min("block").alias("block"))
    pairs = written(verified(sparse, classes, cosine), "vector-links")
    counted = written(_counted(found.where("b is null"), classes, cosine), "dense-counts")
    roots = components(pairs.unionByName(counted.select(F.col("class").alias("a"), F.col("root").alias("b"))))
    size = classes.select("class", "copies")
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ends.join(size.withColumnRenamed("class", "b"), "b").select(F.col("a").alias("class"), F.col("copies").alias("others"))
    linked = linked.unionByName(counted.select("class", "others")).groupBy("class").agg(F.sum("others").alias("others"))
    found = classes.join(linked, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    found = written(found.select("key", "label", "embedding", "least", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class").alias("root")), "vector-classes")
    named = found.join(found.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "label", "embedding", "n_links", "component_id")
    out = good.join(named, ["key", "label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}::DOUBLE),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT reach.a AS r, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.r = reach.b GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""
