"""Heatmap files as a quality report: one error code for each line, in the order in which checks apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import grids as G
from ..functions import paths as P
from ..sources.readers import numbered_lines

POLICIES = ("allow", "error", "first", "last", "max")


def _number(value: Column, kind: Column) -> Column:
    """A finite number; booleans are none."""
    v = F.try_variant_get(value, "$", "double")
    return kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT|INT|SMALLINT|TINYINT)$") & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


SIZES = ("heatmap_width", "heatmap_height", "image_width", "image_height")
#: What a good line parses to at once; any other goes through the slower checks that name its fault.
_GOOD = "image_path variant, heatmap array<array<double>>, " + ", ".join(f"{f} string" for f in SIZES) + ", _bad string"


def _size(text: Column) -> tuple[Column, Column]:
    """(positive whole number or null, whether the field is wrong)."""
    given = F.coalesce(text != "", F.lit(False))
    number = F.floor(text.try_cast("double")).cast("int")
    return F.when(given, number), given & ~F.coalesce(number > 0, F.lit(False))


def report(lines: DataFrame, require_image_size: bool = True) -> DataFrame:
    """(row_idx, image_path, width, height, image_width, image_height, error) of ``lines`` (row_idx, value) that are not blank."""
    # a generated row is computed once, where a projection would be repeated in each use
    once = lambda df, **columns: df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_x")).select(*df.columns, "_x.*")
    rows = lines.where(P.strip(F.col("value")) != "").select("row_idx", "value")
    rows = once(rows, p=F.from_json("value", _GOOD, {"columnNameOfCorruptRecord": "_bad"}))
    rows = once(rows, fast=F.coalesce(F.col("p._bad").isNull() & G.is_rectangular(F.col("p.heatmap")) & (F.schema_of_variant("p.image_path") == "STRING"), F.lit(False)))
    rows = once(rows, json=F.when(~F.col("fast"), F.try_parse_json("value")))
    slow = F.when(F.schema_of_variant("json").startswith("OBJECT"), F.when(F.schema_of_variant(F.try_variant_get("json", "$.image_path", "variant")) == "STRING", P.strip(F.try_variant_get("json", "$.image_path", "string"))))
    path = F.when(F.col("fast"), P.strip(F.try_variant_get("p.image_path", "$", "string"))).otherwise(slow)
    cells = F.transform(F.try_variant_get("json", "$.heatmap", "array<variant>"), lambda r: F.try_variant_get(r, "$", "array<variant>"))
    sizes = {f: F.when(F.col("fast"), F.col(f"p.{f}")).otherwise(F.try_variant_get("json", f"$.{f}", "string")) for f in SIZES}
    rows = once(rows, path=path, cells=cells, **{f"text_{f}": v for f, v in sizes.items()})
    width = F.when(F.col("fast"), G.width(F.col("p.heatmap"))).otherwise(F.size(F.get("cells", F.lit(0))))
    height = F.when(F.col("fast"), F.size("p.heatmap")).otherwise(F.size("cells"))
    checked = {f: _size(F.col(f"text_{f}")) for f in SIZES}
    rows = once(rows, w=width, h=height, **{f: v for f, (v, _) in checked.items()}, **{f"bad_{f}": b for f, (_, b) in checked.items()})
    value, bad = {f: F.col(f) for f in SIZES}, {f: F.col(f"bad_{f}") for f in SIZES}
    width, height = F.col("w"), F.col("h")
    empty = F.coalesce(height, F.lit(0)) < 1
    no_rows = F.get("cells", F.lit(0)).isNull() | (width < 1)
    ragged = F.exists("cells", lambda r: r.isNull() | (F.size(r) != width))
    wrong = F.exists("cells", lambda r: F.exists(r, lambda v: ~F.coalesce(_number(v, F.schema_of_variant(v)), F.lit(False))))
    odd = ~F.col("fast")
    error = (
        F.when(odd & F.col("json").isNull(), "invalid_json")
        .when(odd & ~F.schema_of_variant("json").startswith("OBJECT"), "not_an_object")
        .when(F.coalesce(F.col("path"), F.lit("")) == "", "missing_image_path")
        .when(empty, "empty_heatmap").when(odd & no_rows, "empty_rows").when(odd & ragged, "ragged_rows").when(odd & wrong, "not_finite_numeric")
        .when(bad["heatmap_width"], "bad_heatmap_width").when(bad["heatmap_height"], "bad_heatmap_height")
        .when(value["heatmap_width"] != width, "heatmap_width_mismatch").when(value["heatmap_height"] != height, "heatmap_height_mismatch")
        .when(bad["image_width"], "bad_image_width").when(bad["image_height"], "bad_image_height")
    )
    if require_image_size:
        error = error.when(value["image_width"].isNull() | value["image_height"].isNull(), "missing_image_size")
    return rows.select("row_idx", P.slashes(F.col("path")).alias("image_path"), F.when(~empty, width).alias("width"), F.when(~empty, height).alias("height"), value["image_width"].alias("image_width"), value["image_height"].alias("image_height"), error.alias("error"))


def with_duplicates(checked: DataFrame, policy: str = "allow") -> DataFrame:
    """``checked`` with errors of repeated paths: sizes that differ from the path's first good row, or any repeat under policy error.

    ``checked`` is written once, as narrow verdicts without the lines, so that lines are parsed once;
    only good rows have a part in the join, so rows without a path do not meet in one task.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown duplicate policy: {policy}")
    checked = shared.written(checked, "verdicts")
    good = checked.where("error is null")
    sizes = F.struct("width", "height", "image_width", "image_height")
    firsts = good.groupBy("image_path").agg(F.min("row_idx").alias("_first"), F.min_by(sizes, "row_idx").alias("_s"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    both = good.join(firsts, "image_path", "left")
    again = F.col("row_idx") > F.col("_first")
    differs = (F.col("width") != F.col("_s.width")) | (F.col("height") != F.col("_s.height"))
    error = F.when(again & differs, "duplicate_heatmap_size").when(again & (F.col("image_width") != F.col("_s.image_width")), "duplicate_image_width").when(again & (F.col("image_height") != F.col("_s.image_height")), "duplicate_image_height")
    if policy == "error":
        error = error.when(again, "duplicate_image_path")
    return both.withColumn("error", error).select(*checked.columns).unionByName(checked.where("error is not null"))


def path_stats(checked: DataFrame) -> DataFrame:
    """(image_path, count, and the first good row's sizes)."""
    first = F.min_by(F.struct("width", "height", "image_width", "image_height"), "row_idx").alias("s")
    return checked.where("error is null").groupBy("image_path").agg(F.count("*").alias("count"), first).select("image_path", "count", "s.*")


def validate_file(spark: SparkSession, path: str, policy: str = "allow", require_image_size: bool = True, most_examples: int = 8) -> tuple[DataFrame, list[str]]:
    """(path statistics, warnings); the first faulty line is an error that names it."""
    lines = numbered_lines(spark, path).select("row_idx", "value")
    checked = shared.written(with_duplicates(report(lines, require_image_size), policy), "checked")
    if fault := checked.where("error is not null").orderBy("row_idx").limit(1).collect():
        raise ValueError(f"{fault[0].error} at {path}:{fault[0].row_idx + 1}: {fault[0].image_path}")
    stats = path_stats(checked)
    if stats.isEmpty():
        raise ValueError(f"empty heatmap file: {path}")
    warnings = []
    if blank := lines.where(P.strip(F.col("value")) == "").count():
        warnings.append(f"empty_lines_ignored={blank}")
    if policy in ("first", "last", "max"):
        twice = stats.where("count > 1")
        if n := twice.count():
            some = ", ".join(r.image_path for r in twice.orderBy("image_path").limit(most_examples).collect())
            warnings.append(f"duplicate_image_paths={n} with policy={policy}; examples={some}")
    return stats, warnings


def first_by_key(checked: DataFrame) -> DataFrame:
    """The first row of each path, whatever its verdict."""
    w = Window.partitionBy("image_path").orderBy("row_idx")
    return checked.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
