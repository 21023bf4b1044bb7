"""Reproducible N-way K-shot episodes, split assignment and memory sampling.

``sample`` replays the Mersenne Twister calls of the usual Python sampler, one
task per slice of (setting, episode); ``sample_hashed`` draws by SHA-256 order
instead and is plain SQL.
"""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared

SETTING_STRIDE = 100_000
EPISODES = "setting_idx int, episode_idx int, seed bigint, role string, pos int, class_pos int, row_idx bigint, label string"
#: Rows of an image manifest that a driver may hold as (label, row_idx).
MOST_ROWS = 5_000_000


def parse_grid(text: str) -> list[tuple[int, int]]:
    """'5:1,10:5' -> [(5, 1), (10, 5)]."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        way, colon, shot = part.partition(":")
        if not colon or int(way) <= 0 or int(shot) <= 0:
            raise ValueError(f"settings are n:k with positive numbers: {part}")
        out.append((int(way), int(shot)))
    if not out:
        raise ValueError("no settings")
    return out


def seeds(spark, settings: list[tuple[int, int]], episodes: int, seed: int) -> DataFrame:
    """(setting_idx, n_way, k_shot, episode_idx, seed): the same episodes whatever else varies."""
    rows = spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(settings)], "setting_idx int, n_way int, k_shot int")
    each = rows.withColumn("episode_idx", F.explode(F.sequence(F.lit(0), F.lit(episodes - 1))))
    return each.withColumn("seed", F.lit(seed).cast("long") + F.col("setting_idx").cast("long") * SETTING_STRIDE + F.col("episode_idx"))


def draw(groups: dict[str, list[int]], n_way: int, k_shot: int, queries: int, seed: int) -> tuple[list[str], list[tuple[str, int]], list[tuple[str, int]]]:
    """(classes, support, query): one call to choose classes, one shuffle a class, one of each list."""
    eligible = sorted(c for c, rows in groups.items() if len(rows) >= k_shot + queries)
    if len(eligible) < n_way:
        raise ValueError(f"{n_way} labels with {k_shot + queries} rows are needed, {len(eligible)} have them")
    rng = random.Random(seed)
    classes = rng.sample(eligible, n_way)
    support, query = [], []
    for c in classes:
        rows = list(groups[c])
        rng.shuffle(rows)
        support += [(c, r) for r in rows[:k_shot]]
        query += [(c, r) for r in rows[k_shot : k_shot + queries]]
    rng.shuffle(support)
    rng.shuffle(query)
    return classes, support, query


def sample(records: DataFrame, settings: list[tuple[int, int]], episodes: int, queries: int, seed: int = 42) -> DataFrame:
    """Episodes over ``records`` (row_idx, label) as rows of ``EPISODES``.

    Only labels and row numbers of one split go to the workers; their count is checked.
    """
    n = records.count()
    if n > MOST_ROWS:
        raise ValueError(f"{n} rows: sample_hashed draws from splits of any size")
    groups: dict[str, list[int]] = defaultdict(list)
    for r in records.select("row_idx", "label").orderBy("row_idx").collect():
        groups[r.label].append(r.row_idx)
    groups = dict(groups)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s in pdf.itertuples(index=False):
                classes, support, query = draw(groups, s.n_way, s.k_shot, queries, s.seed)
                place = {c: i for i, c in enumerate(classes)}
                rows += [(s.setting_idx, s.episode_idx, s.seed, role, i, place[c], row, c) for role, part in (("support", support), ("query", query)) for i, (c, row) in enumerate(part)]
            yield pd.DataFrame(rows, columns=["setting_idx", "episode_idx", "seed", "role", "pos", "class_pos", "row_idx", "label"])

    wanted = seeds(records.sparkSession, settings, episodes, seed)
    parts = min(max(1, len(settings) * episodes // 16), int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # drawn once, whatever reads it how often
    return shared.written(wanted.repartition(parts).mapInPandas(made, EPISODES), "episodes")


def _order(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def sample_hashed(records: DataFrame, settings: list[tuple[int, int]], episodes: int, queries: int, seed: int = 42) -> DataFrame:
    """Episodes drawn by SHA-256 order of (seed, label) and (seed, row): (setting_idx, episode_idx, seed, role, row_idx, label)."""
    wanted = seeds(records.sparkSession, settings, episodes, seed)
    counts = records.groupBy("label").agg(F.count("*").alias("n"))
    # labels that each setting can use: an equi-join with its episodes follows
    each = F.array(*[F.struct(F.lit(i).alias("setting_idx"), F.lit(k + queries).alias("needed")) for i, (_, k) in enumerate(settings)])
    eligible = counts.select("label", "n", F.explode(each).alias("s")).where("n >= s.needed").select("label", "s.setting_idx")
    labels = wanted.join(eligible, "setting_idx")
    first = Window.partitionBy("setting_idx", "episode_idx").orderBy(_order(F.col("seed"), F.col("label")))
    chosen = labels.withColumn("_c", F.row_number().over(first)).where(F.col("_c") <= F.col("n_way")).drop("_c")
    rows = chosen.join(records.select("row_idx", "label"), "label")
    within = Window.partitionBy("setting_idx", "episode_idx", "label").orderBy(_order(F.col("seed"), F.col("row_idx")))
    rows = rows.withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= F.col("k_shot") + queries)
    role = F.when(F.col("_r") <= F.col("k_shot"), "support").otherwise("query")
    return shared.written(rows.select("setting_idx", "episode_idx", "seed", role.alias("role"), "row_idx", "label"), "episodes")


def split_count(total: Column, ratio: float) -> Column:
    """How many of ``total`` go to a split: none of two or fewer, else at least one."""
    if ratio <= 0:
        return F.lit(0)
    return F.when(total <= 2, 0).otherwise(F.greatest(F.lit(1), F.bround(total.cast("double") * F.lit(float(ratio))).cast("int")))


def _check_ratios(val_ratio: float, test_ratio: float) -> None:
    if val_ratio < 0 or test_ratio < 0 or val_ratio + test_ratio >= 1:
        raise ValueError("ratios must not be negative and sum to less than 1")


def assign_splits(records: DataFrame, val_ratio: float = 0.15, test_ratio: float = 0.15, seed: int = 42) -> DataFrame:
    """``records`` (row_idx, label, ...) with ``split``: one generator runs over the labels in order, as in ``sample``."""
    _check_ratios(val_ratio, test_ratio)
    spark = records.sparkSession
    if (n := records.count()) > MOST_ROWS:
        raise ValueError(f"{n} rows: assign_splits_hashed takes tables of any size")
    groups: dict[str, list[int]] = defaultdict(list)
    for r in records.select("row_idx", "label").orderBy("row_idx").collect():
        groups[r.label].append(r.row_idx)
    rng, out = random.Random(seed), []

    def count(total: int, ratio: float) -> int:
        return 0 if total <= 2 or ratio <= 0 else max(1, int(round(total * ratio)))

    for label in sorted(groups):
        rows = groups[label]
        rng.shuffle(rows)
        n_test = count(len(rows), test_ratio)
        n_val = count(len(rows) - n_test, val_ratio)
        out += [(r, "test" if i < n_test else "val" if i < n_test + n_val else "train") for i, r in enumerate(rows)]
    splits = spark.createDataFrame(out, "row_idx bigint, split string")
    return records.drop("split").join(splits, "row_idx")


def assign_splits_hashed(records: DataFrame, val_ratio: float = 0.15, test_ratio: float = 0.15, seed: int = 42, row: str = "row_idx", label: str = "label") -> DataFrame:
    """The same shares, in SHA-256 order of (seed, row) within a label."""
    _check_ratios(val_ratio, test_ratio)
    of = Window.partitionBy(label)
    place = F.row_number().over(of.orderBy(_order(F.lit(seed), F.col(row)))) - 1
    total = F.count("*").over(of)
    n_test = split_count(F.col("_n"), test_ratio)
    n_val = split_count(F.col("_n") - F.col("_t"), val_ratio)
    out = records.drop("split").withColumn("_p", place).withColumn("_n", total).withColumn("_t", n_test).withColumn("_v", n_val)
    return out.withColumn("split", F.when(F.col("_p") < F.col("_t"), "test").when(F.col("_p") < F.col("_t") + F.col("_v"), "val").otherwise("train")).drop("_p", "_n", "_t", "_v")


def matches_labels(labels: set[str] | None) -> Column:
    """Whether label, defect or object is among ``labels`` (lower case); None takes all."""
    if labels is None:
        return F.lit(True)
    named = F.transform(F.array("label", "defect_name", "object_name"), lambda x: F.lower(F.coalesce(x, F.lit(""))))
    return F.arrays_overlap(named, F.array(*[F.lit(x) for x in sorted(labels)]))


def parse_label_set(text: str) -> set[str] | None:
    names = {p.strip().lower() for p in text.split(",") if p.strip()}
    return None if not names or "all" in names else names


def select_memory(records: DataFrame, split: str = "train", labels: set[str] | None = None, most: int = 200, seed: int = 42) -> DataFrame:
    """Rows for a memory bank: shuffled and cut only if there are more than ``most``; in path order.

    The shuffle replays the plain sampler's calls over row numbers on the driver; ``select_memory_hashed`` takes tables of any size.
    """
    found = records if split == "all" else records.where(F.col("split") == split)
    found = found.where(matches_labels(labels))
    if most > 0 and (n := found.count()) > most:
        if n > MOST_ROWS:
            raise ValueError(f"{n} rows: select_memory_hashed chooses from tables of any size")
        rows = [r.row_idx for r in found.select("row_idx").orderBy("row_idx").collect()]
        random.Random(seed).shuffle(rows)
        found = found.join(records.sparkSession.createDataFrame([(r,) for r in rows[:most]], "row_idx bigint"), "row_idx", "left_semi")
    return found.orderBy("image_path")


def select_memory_hashed(records: DataFrame, split: str = "train", labels: set[str] | None = None, most: int = 200, seed: int = 42) -> DataFrame:
    """The same, the first ``most`` rows in SHA-256 order of (seed, row)."""
    found = records if split == "all" else records.where(F.col("split") == split)
    found = found.where(matches_labels(labels))
    chosen = found.orderBy(_order(F.lit(seed), F.col("row_idx")), "row_idx").limit(most) if most > 0 else found
    return chosen.orderBy("image_path")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _hash_vector(keys: pd.Series, dims: pd.Series) -> pd.Series:
    out = []
    for key, dim in zip(keys, dims, strict=True):
        rng = random.Random(int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big"))
        out.append([rng.uniform(-1.0, 1.0) for _ in range(dim)])
    return pd.Series(out)


def hash_features(path: Column, label: Column, salt: str, dim: int = 64) -> Column:
    """Placeholder vectors that depend on salt, path and label alone; equal salts give equal vectors anywhere."""
    return _hash_vector(F.concat_ws(":", F.lit(salt), path, label), F.lit(dim))
