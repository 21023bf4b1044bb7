"""Box diagnostics: ground truth against pseudo boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import boxes as B
from . import merge
from . import metrics as M

STATUSES = ("matched", "missing_pseudo", "invalid_gt_bbox", "invalid_pseudo_bbox")


def compare(truth: DataFrame, pseudo: DataFrame, order: str = "row_idx") -> DataFrame:
    """``truth`` rows with status, iou, gt_area, pseudo_area, area_ratio, gt_box and pseudo_box.

    Pseudo rows are found by raw or slash-normalised path, the last row of a path counts.
    """
    columns = [c for c in pseudo.columns if c not in ("image_path", order)]
    joined = merge.lookup(truth, pseudo, "image_path", columns, normalize_table=True, order=order)
    other = "found_bbox" if "bbox" in truth.columns else "bbox"
    return measure(parsed(joined, gt_box="bbox", pseudo_box=other), "found")


def parsed(rows: DataFrame, **boxes: str) -> DataFrame:
    """``rows`` with a box for each text column; generated rows are computed once, where a projection would be repeated in each use."""
    once = lambda df, name, of: df.select("*", F.explode(F.array(F.struct(*[of(n).alias(n) for n in boxes]))).alias(name))
    split = once(rows, "_parts", lambda n: B.parts(F.col(boxes[n])))
    found = once(split, "_numbers", lambda n: B.numbers(F.col(f"_parts.{n}")))
    return found.select(*rows.columns, *[B.valid(F.col(f"_numbers.{n}")).alias(n) for n in boxes])


def measure(rows: DataFrame, found: str | None = None) -> DataFrame:
    """Status and measures of rows with gt_box and pseudo_box."""
    g, p = F.col("gt_box"), F.col("pseudo_box")
    status = F.when(~F.col(found), "missing_pseudo") if found else F.when(F.lit(False), "")
    status = status.when(g.isNull(), "invalid_gt_bbox").when(p.isNull(), "invalid_pseudo_bbox").otherwise("matched")
    ok = F.col("status") == "matched"
    rows = rows.withColumn("status", status)
    return rows.withColumns({"iou": F.when(ok, B.iou(g, p)), "gt_area": F.when(ok, B.area(g)), "pseudo_area": F.when(ok, B.area(p)), "area_ratio": F.when(ok, B.area_ratio(p, g))})


_SHARES = {"median": 0.5, "p25": 0.25, "p75": 0.75}


def summarize(measured: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Counts by status, the eight-number summaries of iou and finite area ratio, and recall at IoU, one row for each key."""
    finite = F.when(F.abs("area_ratio") < float("inf"), F.col("area_ratio"))
    rows = shared.written(measured.select(*keys, "status", "iou", finite.alias("_ratio")), "measures")
    counts = [F.count("*").alias("gt_rows"), *[F.count_if(F.col("status") == s).alias(f"{s}_rows") for s in STATUSES]]
    out = rows.groupBy(*keys).agg(*counts, *M.summary("iou", "iou_"), *M.summary("_ratio", "area_ratio_"), *M.recalls("iou"))
    shares = M.percentiles(rows, list(keys), {"iou": {f"iou_{k}": q for k, q in _SHARES.items()}, "_ratio": {f"area_ratio_{k}": q for k, q in _SHARES.items()}})
    if not keys:
        return out.join(shares, F.lit(True), "left")
    other = shares.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & out[k].eqNullSafe(other[f"_of_{k}"])
    return out.join(other, on, "left").drop(*[f"_of_{k}" for k in keys])


def worst(measured: DataFrame, k: int = 10, keys: list[str] = (), order: str = "row_idx") -> DataFrame:
    """The k matched rows of least IoU, ties in row order; with keys also their ``rank``.

    The limit on the rank lets each task send on k rows a key at most (the plan's WindowGroupLimit).
    """
    rows = measured.where("status = 'matched'")
    if not keys:
        return rows.orderBy("iou", order).limit(k)
    w = Window.partitionBy(*keys).orderBy("iou", order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank(summary: DataFrame, setting: str = "setting_idx") -> DataFrame:
    """Sweep results with ``rank``: mean IoU, recall at .50 and .25, median, then sweep order; settings are few."""
    last = lambda c: F.coalesce(F.col(c), F.lit(-1.0)).desc()
    order = Window.orderBy(last("iou_mean"), last("recall_50"), last("recall_25"), last("iou_median"), setting)
    return summary.withColumn("rank", F.row_number().over(order))
