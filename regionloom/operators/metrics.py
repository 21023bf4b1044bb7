"""Classification metrics over (keys..., y_true, y_pred): aggregate to the confusion table first, everything after is classes squared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared


def confusion(predictions: DataFrame, keys: list[str] = (), order: str | None = None) -> DataFrame:
    """(keys, y_true, y_pred, count), and ``first_pos`` if ``order`` names a position column."""
    more = [F.min(order).alias("first_pos")] if order else []
    return predictions.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("count"), *more)


def per_class(cells: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, label, true_count, pred_count, correct, precision, recall, f1) over the labels of either side."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("count")).otherwise(0)
    sides = F.array(F.struct(F.col("y_true").alias("label"), F.col("count").alias("t"), F.lit(0).cast("long").alias("p"), hit.alias("c")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("t"), F.col("count").alias("p"), F.lit(0).cast("long").alias("c")))
    each = cells.select(*keys, F.explode(sides).alias("s")).groupBy(*keys, F.col("s.label").alias("label"))
    out = each.agg(F.sum("s.t").alias("true_count"), F.sum("s.p").alias("pred_count"), F.sum("s.c").alias("correct"))
    ratio = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    out = out.withColumn("precision", ratio(F.col("correct"), F.col("pred_count"))).withColumn("recall", ratio(F.col("correct"), F.col("true_count")))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(2 * p * r, p + r))


def scores(cells: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, n, accuracy, balanced_accuracy, macro_f1); without keys one row, zeros if empty."""
    c = per_class(cells, keys)
    out = c.groupBy(*keys).agg(
        F.coalesce(F.sum("true_count"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("correct") / F.nullif(F.sum("true_count"), F.lit(0)), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.avg(F.when(F.col("true_count") > 0, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
    )
    return out


def top_confusions(cells: DataFrame, keys: list[str] = (), k: int = 20) -> DataFrame:
    """The k most frequent mistakes: (keys, rank, y_true, y_pred, count, fraction_of_true); ties by first occurrence, else by label."""
    total = F.sum("count").over(Window.partitionBy(*keys, "y_true"))
    wrong = cells.withColumn("fraction_of_true", F.col("count") / total).where("y_true <> y_pred")
    ties = ["first_pos"] if "first_pos" in cells.columns else []
    order = Window.partitionBy(*keys or [F.lit(0)]).orderBy(F.desc("count"), F.desc("fraction_of_true"), *ties, "y_true", "y_pred")
    return wrong.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*keys, "rank", "y_true", "y_pred", "count", "fraction_of_true")


def compare_per_class(region: DataFrame, baseline: DataFrame) -> DataFrame:
    """Region against baseline, class by class; a class that one side lacks counts zero there."""
    a, b = ({c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0)) for c in ("recall", "f1", "correct")} for side in ("r", "b"))
    both = region.alias("r").join(baseline.alias("b"), "label", "full_outer")
    return both.select(
        "label", F.coalesce("r.true_count", F.lit(0)).alias("true_count"),
        a["recall"].alias("region_recall"), b["recall"].alias("baseline_recall"), (a["recall"] - b["recall"]).alias("recall_delta"),
        a["f1"].alias("region_f1"), b["f1"].alias("baseline_f1"), (a["f1"] - b["f1"]).alias("f1_delta"),
        a["correct"].alias("region_correct"), b["correct"].alias("baseline_correct"), (a["correct"] - b["correct"]).alias("correct_delta"),
    )


def delta_order() -> list:
    """Columns that order ``compare_per_class``: the largest gain first, ties by label."""
    return [F.desc("recall_delta"), F.desc("f1_delta"), F.desc("true_count"), F.asc("label")]


def mean_stdev(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and sample deviation (0 for one row) of each value."""
    return df.groupBy(*keys).agg(*[x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_stdev"))])


def summary(value: str, prefix: str = "") -> list:
    """Aggregates: count, mean, stdev, min, max; all but the count null for no rows."""
    n = F.count(value)
    named = {"count": n, "mean": F.avg(value), "stdev": F.when(n > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0))), "min": F.min(value), "max": F.max(value)}
    return [c.alias(prefix + k) for k, c in named.items()]


def percentiles(rows: DataFrame, keys: list[str], values: dict[str, dict[str, float]]) -> DataFrame:
    """(keys, names): exact interpolated percentiles of each measure, ``values`` being measure -> {name: share}.

    No task holds a whole measure: equal values are one row with a count, combined before the shuffle; these are
    sorted by range over all tasks; counts of the sorted parts say in which part a rank lies, and only those parts
    are ranked value by value.  Null and NaN values count for nothing; a null key is a key like any other.
    """
    each = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("_m"), F.col(m).cast("double").alias("_v")) for m in values])).alias("_e")).select(*keys, "_e.*")
    # a group's number stands for its keys in every join
    each = each.where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_v", F.col("_v") + F.lit(0.0))
    each = each.groupBy(F.struct(*[F.col(k) for k in keys] or [F.lit(0).alias("_")]).alias("_k"), "_m", "_v").agg(F.count("*").alias("_n"))
    table = shared.written(each.orderBy("_k", "_m", "_v"), "measure-values")
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    table = table.select(F.to_json("_k", {"ignoreNullFields": "false"}).alias("_g"), "_k", "_m", "_v", "_n", part.alias("_part"))
    # a row for each group and part that it lies in
    parts = table.groupBy("_g", "_m", "_part").agg(F.sum("_n").alias("_in"), F.first("_k").alias("_k"))
    group = Window.partitionBy("_g", "_m")
    parts = parts.withColumn("_before", F.coalesce(F.sum("_in").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_in").over(group))
    wanted = F.array(*[F.struct(F.lit(m).alias("of"), F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for m, some in values.items() for name, q in some.items()])
    at = F.col("_q.q") * (F.col("_all") - 1)
    # the two ranks that a share lies between, with their weights
    two = F.array(F.struct(F.floor(at).alias("r"), (1 - (at - F.floor(at))).alias("w")), F.struct(F.ceil(at).alias("r"), (at - F.floor(at)).alias("w")))
    ranks = parts.select("*", F.explode(wanted).alias("_q")).where("_q.of = _m").select("_g", "_m", "_k", "_part", "_before", "_in", F.col("_q.name").alias("_name"), F.explode(two).alias("_r"))
    ranks = ranks.where((F.col("_r.w") > 0) & (F.col("_r.r") >= F.col("_before")) & (F.col("_r.r") < F.col("_before") + F.col("_in")))
    ranks = shared.written(ranks.select("_g", "_m", "_k", "_part", "_before", "_name", F.col("_r.r").alias("_rank"), F.col("_r.w").alias("_w")), "measure-ranks")
    few = ranks.select("_g", "_m", "_part", "_before").distinct()
    hit = table.drop("_k").join(few, ["_g", "_m", "_part"])
    hit = hit.withColumn("_end", F.col("_before") + F.sum("_n").over(Window.partitionBy("_g", "_m", "_part").orderBy("_v"))).drop("_before")
    found = ranks.join(hit, ["_g", "_m", "_part"]).where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n")))
    out = found.groupBy("_g").agg(F.first("_k").alias("_k"), *[F.sum(F.when((F.col("_m") == m) & (F.col("_name") == name), F.col("_v") * F.col("_w"))).alias(name) for m, some in values.items() for name in some])
    return out.select(*[F.col(f"_k.{k}").alias(k) for k in keys], *[name for some in values.values() for name in some])


def recalls(value: str, at=(0.10, 0.25, 0.50, 0.75), prefix: str = "recall_") -> list:
    """Aggregates: the share of rows at or above each threshold; null for no rows."""
    return [F.avg((F.col(value) >= t).cast("double")).alias(f"{prefix}{int(round(t * 100)):02d}") for t in at]
