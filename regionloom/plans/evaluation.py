"""Whole evaluations as one plan each: few-shot grids, fused branches, confusion analysis, box sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import classify, episodes, iou, merge, metrics, regions
from ..sources import readers

GRID = "5:1,5:3,5:5,10:1,10:5"
EPISODE = ["setting_idx", "episode_idx"]
MEASURES = ["accuracy", "balanced_accuracy", "macro_f1"]


def records_with_features(records: DataFrame, features: DataFrame, dim: int | None = None) -> DataFrame:
    """``records`` (row_idx, image_path, label) with ``feature``, found under raw, then slash-normalised path; a miss is an error."""
    out = merge.lookup(records.select("row_idx", "image_path", "label"), features.withColumnRenamed("key", "_path"), "image_path", ["feature"]) if "key" not in features.columns else _by_key(records, features)
    missing = F.raise_error(F.concat(F.lit("no feature for "), "image_path")).cast("array<double>")
    feature = F.when(F.col("found"), F.col("feature")).otherwise(missing)
    if dim is not None:
        wrong = F.raise_error(F.concat(F.lit(f"feature dimension is not {dim}: "), F.size("feature").cast("string"))).cast("array<double>")
        feature = F.when(~F.col("found") | (F.size("feature") == dim), feature).otherwise(wrong)
    return out.select("row_idx", "label", feature.alias("feature"))


def _by_key(records: DataFrame, features: DataFrame) -> DataFrame:
    return merge.lookup(records.select("row_idx", "image_path", "label"), features.select(F.col("key").alias("image_path"), "feature"), "image_path", ["feature"])


def predictions(drawn: DataFrame, features: DataFrame) -> DataFrame:
    """(setting_idx, episode_idx, pos, y_true, y_pred, score) of prototype classification; ties by first place in the support."""
    scores = classify.episode_scores(drawn, features, EPISODE)
    best = classify.argmax(scores, [*EPISODE, "pos", "y_true"], [F.col("class_pos").asc()])
    return best


def fused_predictions(drawn: DataFrame, whole: DataFrame, region: DataFrame, weights: list[float]) -> DataFrame:
    """(weight_idx, whole_weight, setting_idx, episode_idx, pos, y_true, y_pred, score); ties by label."""
    w, r = (classify.episode_scores(drawn, f, EPISODE) for f in (whole, region))
    grid = classify.weight_grid(w, r, weights, EPISODE)
    return classify.argmax(grid, ["weight_idx", "whole_weight", *EPISODE, "pos", "y_true"], [F.col("class").asc()])


def episode_metrics(predicted: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.scores(metrics.confusion(predicted, keys), keys)


def few_shot_grid(records: DataFrame, features: DataFrame, grid: str = GRID, queries: int = 5, count: int = 200, seed: int = 42) -> DataFrame:
    """(setting_idx, n_way, k_shot, episodes, each measure's mean and stdev)."""
    settings = episodes.parse_grid(grid)
    drawn = episodes.sample(records, settings, count, queries, seed)
    each = episode_metrics(predictions(drawn, features), EPISODE)
    return _named(metrics.mean_stdev(each, ["setting_idx"], MEASURES), settings, count)


def region_context_grid(records: DataFrame, whole: DataFrame, region: DataFrame, weights: list[float] = (0.5,), grid: str = GRID, queries: int = 5, count: int = 200, seed: int = 42) -> DataFrame:
    """The same for the fusion of two branches, by weight; every weight sees the same episodes."""
    settings = episodes.parse_grid(grid)
    drawn = episodes.sample(records, settings, count, queries, seed)
    keys = ["weight_idx", "whole_weight", *EPISODE]
    each = episode_metrics(fused_predictions(drawn, whole, region, list(weights)), keys)
    return _named(metrics.mean_stdev(each, ["weight_idx", "whole_weight", "setting_idx"], MEASURES), settings, count)


def _named(df: DataFrame, settings: list[tuple[int, int]], count: int) -> DataFrame:
    at = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in settings]), F.col("setting_idx") + 1)
    return df.withColumns({"n_way": at(0), "k_shot": at(1), "episodes": F.lit(count)})


def confusion_analysis(records: DataFrame, whole: DataFrame, region: DataFrame, n_way: int, k_shot: int, baseline: DataFrame | None = None, whole_weight: float = 0.75, queries: int = 5, count: int = 200, seed: int = 42, top_k: int = 20) -> dict[str, DataFrame]:
    """Pooled predictions of both models over the same episodes: overall, per_class, deltas, confusions."""
    drawn = episodes.sample(records, [(n_way, k_shot)], count, queries, seed)
    models = {"region_context": fused_predictions(drawn, whole, region, [whole_weight]).select(*EPISODE, "pos", "y_true", "y_pred")}
    if baseline is not None:
        models["baseline"] = predictions(drawn, baseline).select(*EPISODE, "pos", "y_true", "y_pred")
    pooled = None
    for name, p in models.items():
        p = p.withColumn("model", F.lit(name)).withColumn("at", F.col("episode_idx").cast("long") * 1_000_000 + F.col("pos"))
        pooled = p if pooled is None else pooled.unionByName(p)
    cells = metrics.confusion(pooled, ["model"], order="at")
    per_class = metrics.per_class(cells, ["model"])
    each = metrics.scores(metrics.confusion(pooled, ["model", "episode_idx"]), ["model", "episode_idx"])
    out = {"overall": metrics.scores(cells, ["model"]).join(metrics.mean_stdev(each, ["model"], MEASURES), "model"), "per_class": per_class, "confusions": metrics.top_confusions(cells, ["model"], top_k)}
    if baseline is not None:
        sides = {m: per_class.where(F.col("model") == m).drop("model") for m in models}
        out["deltas"] = metrics.compare_per_class(sides["region_context"], sides["baseline"])
    return out


def box_sweep(manifest: DataFrame, heatmaps: DataFrame, percentiles=(0.85, 0.90, 0.95), ratios=(0.0005, 0.001, 0.005), components=("largest", "max-score"), missing: str = "error", upsample: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ranked summary of each setting, measured rows): heatmaps are labelled once for each percentile, whatever the other parameters."""
    if missing not in ("error", "skip"):
        raise ValueError(f"unknown policy: {missing}")
    rows = merge.lookup(manifest, heatmaps, "image_path", ["heatmap", "image_width", "image_height"])
    if missing == "error":
        merge.fill_missing(rows.select("image_path", "found"), [], "error")
    settings = regions.settings_table(manifest.sparkSession, list(percentiles), list(ratios), list(components))
    found = rows.where("found").select("row_idx", "heatmap", "image_width", "image_height")
    table = regions.component_table(found, list(percentiles), ["row_idx"], upsample)
    chosen = regions.choose(table, ["row_idx"], settings).select("row_idx", "setting_idx", "box", "score", "area")
    grid = rows.drop("heatmap", "image_width", "image_height").join(settings)
    joined = iou.parsed(grid.join(chosen, ["row_idx", "setting_idx"], "left").withColumnRenamed("box", "pseudo_box"), gt_box="bbox")
    measured = iou.measure(joined, "found")
    keys = ["setting_idx", "percentile", "min_area_ratio", "component"]
    return iou.rank(iou.summarize(measured, keys)), measured


def per_image(measured: DataFrame) -> DataFrame:
    """Matched rows of ``iou.compare`` as they are written: boxes as text."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in measured.columns else F.lit("")
    rows = measured.where("status = 'matched'")
    boxes = {"gt_bbox": B.format_box("gt_box"), "pseudo_bbox": B.format_box("pseudo_box")}
    return rows.select("row_idx", *[of(c).alias(c) for c in ("image_path", "label", "split", "object_name", "defect_name")], *[v.alias(k) for k, v in boxes.items()], "iou", "gt_area", "pseudo_area", "area_ratio", *[of(c).alias(c) for c in ("bbox_source", "pseudo_bbox_score", "pseudo_bbox_area")])


def sweep_rows(ranked: DataFrame, upsample: bool = False) -> DataFrame:
    """The ranked sweep as its CSV has it."""
    counts = {"gt_rows": "gt_rows", "missing_heatmap_rows": "missing_pseudo_rows", "invalid_gt_bbox_rows": "invalid_gt_bbox_rows"}
    means = {"mean_iou": "iou_mean", "median_iou": "iou_median", "recall_iou_025": "recall_25", "recall_iou_050": "recall_50", "mean_area_ratio": "area_ratio_mean"}
    found = (F.col("gt_rows") - F.col("missing_pseudo_rows")).alias("matched_heatmap_rows")
    return ranked.select("rank", "setting_idx", "percentile", "min_area_ratio", "component", F.lit("bilinear_to_image" if upsample else "native_grid").alias("heatmap_processing"), F.col("gt_rows"), found, F.col("iou_count").alias("evaluated_rows"), *[F.col(v).alias(k) for k, v in list(counts.items())[1:]], *[F.col(v).alias(k) for k, v in means.items()])


def sweep_manifest(measured: DataFrame, columns: list[str], setting: dict, upsample: bool = False) -> DataFrame:
    """The pseudo-box manifest of one setting: the source's columns, then what the sweep adds."""
    rows = measured.where((F.col("setting_idx") == setting["setting_idx"]) & F.col("pseudo_box").isNotNull())
    added = {
        "bbox": B.format_box("pseudo_box"), "bbox_source": F.lit("pseudo_heatmap_sweep" + ("_upsampled" if upsample else "")), "pseudo_bbox_score": B.six_decimals("score"), "pseudo_bbox_area": F.col("area").cast("string"),
        "pseudo_bbox_percentile": F.lit(f"{setting['percentile']:g}"), "pseudo_bbox_min_area_ratio": F.lit(f"{setting['min_area_ratio']:g}"), "pseudo_bbox_component": F.lit(setting["component"]), "pseudo_bbox_heatmap_processing": F.lit("bilinear_to_image" if upsample else "native_grid"),
    }
    kept = [c for c in columns if c not in added]
    return rows.select(*kept, *[v.alias(k) for k, v in added.items()]).select("row_idx", *[c for c in columns if c != "row_idx"], *[c for c in added if c not in columns])


def load_split(spark, manifest: str, split: str) -> DataFrame:
    return readers.require(readers.by_split(readers.load_manifest(spark, manifest), split, everything=False), f"no rows of split {split} in {manifest}")
