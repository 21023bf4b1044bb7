"""Duplicate heatmaps, coverage and keyed look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grids as G
from ..functions import paths as P
from ..functions import vectors as V

POLICIES = ("error", "first", "last", "max")
SIZES = ("image_width", "image_height", "heatmap_width", "heatmap_height")


def _failed(message: str, key: str, kind: str) -> Column:
    return F.raise_error(F.concat(F.lit(message + ": "), F.col(key).cast("string"))).cast(kind)


def pixel_max(heatmaps: DataFrame, keys: list[str], value: str = "heatmap") -> DataFrame:
    """(keys, heatmap): the greatest value of each cell of equally large heatmaps, aggregated cell by cell before the shuffle."""
    cells = heatmaps.select(*keys, G.width(F.col(value)).alias("_w"), F.posexplode(F.flatten(value)).alias("_at", "_v"))
    cells = cells.groupBy(*keys, "_at").agg(F.max("_v").alias("_v"), F.max("_w").alias("_w"))
    flat = cells.groupBy(*keys).agg(F.max("_w").alias("_w"), F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda s: s["_v"]).alias("_flat"))
    return flat.select(*keys, V.rows_of(F.col("_flat"), F.col("_w")).alias(value))


def merge_duplicates(heatmaps: DataFrame, policy: str = "max", key: str = "image_path", order: str = "row_idx") -> DataFrame:
    """One row for each key, with ``duplicate_count`` and ``first_row``.

    first and last keep that row's payload; max keeps the first payload with the
    cell-wise greatest heatmap and the first size that is given, unequal sizes
    being an error; error fails on any repeated key.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown duplicate policy: {policy}")
    columns = [c for c in heatmaps.columns if c not in (key, order)]
    payload = columns
    pick = F.max_by if policy == "last" else F.min_by
    value = F.struct(*payload) if payload else F.struct(order)
    aggregates = [pick(value, order).alias("_v"), F.count("*").alias("duplicate_count"), F.min(order).alias("first_row")]
    sizes = [c for c in SIZES if c in columns]
    shape = policy == "max" and "heatmap" in columns
    if policy == "max":
        for c in sizes:
            given = F.nullif(F.col(c).cast("string"), F.lit(""))
            aggregates += [F.min_by(F.col(c), F.when(given.isNotNull(), F.col(order))).alias(f"_{c}"), F.min(given).alias(f"_{c}_least"), F.max(given).alias(f"_{c}_most")]
        if shape:
            wide = F.struct(G.height(F.col("heatmap")).alias("h"), F.array_min(F.transform("heatmap", F.size)).alias("a"), F.array_max(F.transform("heatmap", F.size)).alias("b"))
            aggregates += [F.min(wide).alias("_least"), F.max(wide).alias("_most")]
    out = heatmaps.groupBy(key).agg(*aggregates)
    if policy == "error":
        out = out.withColumn("duplicate_count", F.when(F.col("duplicate_count") == 1, F.col("duplicate_count")).otherwise(_failed("repeated image_path", key, "bigint")))
    fields = {c: F.col(f"_v.{c}") for c in payload}
    if policy == "max":
        for c in sizes:
            same = F.col(f"_{c}_least").eqNullSafe(F.col(f"_{c}_most"))
            fields[c] = F.when(same, F.col(f"_{c}")).otherwise(_failed(f"conflicting {c}", key, heatmaps.schema[c].dataType.simpleString()))
        if shape:
            # only repeated keys have cells to compare
            again = out.where("duplicate_count > 1").select(key)
            merged = pixel_max(heatmaps.join(again, key, "left_semi").where(F.col("heatmap").isNotNull()), [key]).withColumnRenamed("heatmap", "_merged")
            same = (F.col("_least") == F.col("_most")) & (F.col("_least.a") == F.col("_least.b")) & (F.col("_least.h") > 0)
            out = out.join(merged, key, "left")
            fields["heatmap"] = F.when(same, F.coalesce("_merged", "_v.heatmap")).otherwise(_failed("unequal heatmap sizes, or no heatmap", key, G.GRID))
    return out.select(key, *[fields[c].alias(c) for c in columns], "duplicate_count", "first_row")


def missing_and_extra(expected: DataFrame, found: DataFrame, key: str = "image_path") -> tuple[DataFrame, DataFrame]:
    """Normalised paths of each side that the other lacks."""
    a, b = (d.select(P.normalize_path(F.col(key)).alias(key)).distinct() for d in (expected, found))
    return a.join(b, key, "left_anti"), b.join(a, key, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionByName(b.subtract(a))


def require_same_keys(a: DataFrame, b: DataFrame, key: str = "image_path") -> None:
    """An error with up to five examples unless both sides have the same keys."""
    if odd := symmetric_difference(a.select(key), b.select(key)).orderBy(key).limit(5).collect():
        raise ValueError("keys differ, such as " + ", ".join(str(r[0]) for r in odd))


def lookup(probe: DataFrame, table: DataFrame, key: str, value_columns: list[str], normalize_table: bool = False, order: str | None = None) -> DataFrame:
    """``probe`` left joined to ``table`` by raw path, then with forward slashes, then in plain POSIX form.

    With ``normalize_table`` the table is also found under its own normalised
    path; of several rows under a key the last in ``order`` counts.
    """
    value = F.struct(*value_columns)
    built = table.select(F.col(key).alias("_k"), value.alias("_v"), (F.col(order) if order else F.lit(0)).alias("_o"))
    if normalize_table:
        built = built.where(P.strip(F.col("_k")) != "").withColumn("_k", F.explode(F.array_distinct(F.array(F.col("_k"), P.slashes(F.col("_k"))))))
    built = built.groupBy("_k").agg(F.max_by("_v", "_o").alias("_v"))
    both = probe.withColumn("_keys", P.key_variants(F.col(key)))
    # a later form is only asked for where the forms before it found nothing; equal forms are asked for once
    found = F.lit(None)
    for i in range(3):
        form = F.when(found.isNull(), F.get("_keys", F.lit(i)))
        both = both.join(built.withColumnRenamed("_v", f"_v{i}"), form == F.col("_k"), "left").drop("_k")
        found = F.coalesce(*[F.col(f"_v{j}") for j in range(i + 1)])
    return both.withColumn("_found", found).select(*probe.columns, *[F.col(f"_found.{c}").alias(c if c not in probe.columns else f"found_{c}") for c in value_columns], F.col("_found").isNotNull().alias("found"))


def fill_missing(joined: DataFrame, columns: list[str], policy: str, found: str = "found", source: str = "bbox_source") -> DataFrame:
    """What rows without a heatmap get: blanks (clear), what they had (keep), or an error."""
    if policy not in ("error", "clear", "keep"):
        raise ValueError(f"unknown policy: {policy}")
    lost = ~F.col(found)
    if policy == "error":
        n, some = joined.where(lost).agg(F.count("*"), F.slice(F.sort_array(F.collect_set("image_path")), 1, 5)).first() if not joined.where(lost).isEmpty() else (0, [])
        if n:
            raise ValueError(f"missing heatmaps for {n} rows, such as {', '.join(some)}")
        return joined
    out = joined
    if policy == "clear":
        for c in columns:
            out = out.withColumn(c, F.when(lost, F.lit("")).otherwise(F.col(c)))
    return out.withColumn(source, F.when(lost, F.lit(f"missing_heatmap_{policy}")).otherwise(F.col(source)))


def fuse_caches(whole: DataFrame, region: DataFrame, method: str = "concat", alpha: float = 0.5, normalize_input: bool = False, normalize_output: bool = False) -> DataFrame:
    """The whole cache's payload with fused features, in path order; both caches must have the same paths."""
    require_same_keys(whole, region)
    r = region.select("image_path", F.col("feature").alias("_f"), *[F.col(c).alias(f"_{c}") for c in ("region", "crop_box") if c in region.columns])
    fused = V.fuse(F.col("feature"), F.col("_f"), method, alpha, normalize_input, normalize_output)
    out = whole.join(r, "image_path").withColumn("feature", fused).withColumn("fusion_method", F.lit(method)).withColumn("fusion_alpha", F.lit(float(alpha)) if method == "weighted-sum" else F.lit(None).cast("double"))
    out = out.withColumn("whole_region", F.coalesce(F.col("region"), F.lit("whole")) if "region" in whole.columns else F.lit("whole")).withColumn("region_region", F.coalesce(F.col("_region"), F.lit("region")) if "_region" in r.columns else F.lit("region"))
    out = out.withColumn("region_crop_box", F.col("_crop_box") if "_crop_box" in r.columns else F.lit(None).cast("array<int>"))
    return out.drop("_f", "_region", "_crop_box").orderBy("image_path")
