"""Markdown and JSON documents from small collected results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources import readers


def number(value) -> str:
    """NA for null, whole numbers as they are, else four decimals."""
    if value is None:
        return "NA"
    return str(value) if isinstance(value, int) else f"{value:.4f}"


def percent(mean: float, stdev: float, sign: str = "±") -> str:
    return f"{mean * 100:.2f} {sign} {stdev * 100:.2f}"


def slug(value: float) -> str:
    """A number as a part of a file name."""
    return f"{value:g}".replace(".", "p").replace("-", "m")


def setting_file(upsample: bool, percentile: float, ratio: float, component: str) -> str:
    return f"pseudo_bbox_{'upsampled' if upsample else 'native'}_p{slug(percentile)}_area{slug(ratio)}_{component}.csv"


def table(header: list[str], rows: list[list], right: int = 0) -> list[str]:
    """Lines of a Markdown table, the last ``right`` columns flush right."""
    rule = ["---"] * (len(header) - right) + ["---:"] * right
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return [line(header), "|" + "|".join(rule) + "|", *[line(r) for r in rows]]


def grid_markdown(title: str, facts: dict[str, str], results: list[dict], sign: str = "±", weights: bool = False) -> str:
    rows = [[*([f"{r['whole_weight']:g}"] if weights else []), f"{r['n_way']}-way {r['k_shot']}-shot", r["episodes"], *[percent(r[f"{m}_mean"], r[f"{m}_stdev"], sign) for m in ("accuracy", "balanced_accuracy", "macro_f1")]] for r in results]
    header = [*(["Whole weight"] if weights else []), "Setting", "Episodes", "Accuracy", "Balanced Acc", "Macro-F1"]
    return "\n".join([f"# {title}", "", *[f"- {k.capitalize()}: `{v}`" for k, v in facts.items()], "", *table(header, rows, 4), ""])


def grid_document(facts: dict, results: list[dict]) -> dict:
    """Facts and, for each result, its setting and the mean and deviation of each measure."""
    nested = lambda r: {m: {k: r[f"{m}_{k}"] for k in ("mean", "stdev")} for m in ("accuracy", "balanced_accuracy", "macro_f1")}
    rest = lambda r: {k: v for k, v in r.items() if not k.endswith(("_mean", "_stdev"))}
    return {**facts, "results": [{**rest(r), "metrics": nested(r)} for r in results]}


def iou_document(summary: dict, worst: list[dict]) -> dict:
    """The nested document of one summary row."""
    part = lambda p: {k: summary[f"{p}_{k}"] for k in ("count", "mean", "median", "stdev", "min", "p25", "p75", "max")}
    counts = {k: v for k, v in summary.items() if k.endswith("_rows")}
    return {"counts": counts, "iou": part("iou"), "area_ratio": part("area_ratio"), "recall_at_iou": {f"0.{k[7:]}": v for k, v in summary.items() if k.startswith("recall_")}, "worst_examples": worst}


def iou_markdown(document: dict) -> str:
    lines = ["# Pseudo box against ground truth", "", *table(["Count", "Rows"], list(document["counts"].items()), 1), ""]
    keys = ("count", "mean", "median", "stdev", "min", "p25", "p75", "max")
    lines += table(["Measure", *keys], [[m, *[number(document[m][k]) for k in keys]] for m in ("iou", "area_ratio")], len(keys)) + [""]
    lines += table(["IoU at least", "Share"], [[k, number(v)] for k, v in document["recall_at_iou"].items()], 1) + [""]
    return "\n".join([*lines, *table(["Image", "IoU"], [[w["image_path"], number(w["iou"])] for w in document["worst_examples"]], 1), ""])


def sweep_markdown(results: list[dict]) -> str:
    rows = [[r["rank"], f"{r['percentile']:g}", f"{r['min_area_ratio']:g}", r["component"], *[number(r[k]) for k in ("iou_mean", "iou_median", "recall_25", "recall_50", "area_ratio_mean")]] for r in results]
    return "\n".join(["# Pseudo box sweep", "", *table(["Rank", "Percentile", "Min area", "Component", "Mean IoU", "Median IoU", "R@0.25", "R@0.50", "Area ratio"], rows, 5), ""])


def confusion_markdown(overall: list[dict], deltas: list[dict], confusions: list[dict]) -> str:
    lines = ["# Confusion analysis", "", *table(["Model", "Queries", "Accuracy", "Balanced Acc", "Macro-F1"], [[o["model"], o["n"], *[number(o[k]) for k in ("accuracy", "balanced_accuracy", "macro_f1")]] for o in overall], 4), ""]
    signed = lambda v: f"{v:+.4f}"
    if deltas:
        lines += table(["Label", "True", "Recall delta", "F1 delta"], [[d["label"], d["true_count"], signed(d["recall_delta"]), signed(d["f1_delta"])] for d in deltas], 3) + [""]
    return "\n".join([*lines, *table(["Model", "True", "Pred", "Count", "Share of true"], [[c["model"], c["y_true"], c["y_pred"], c["count"], number(c["fraction_of_true"])] for c in confusions], 2), ""])


def model_summary(status: DataFrame, results: DataFrame | None) -> DataFrame:
    """A row for each model and setting; models without results keep one with dashes."""
    cell = lambda c: P.escape_cell(F.coalesce(F.col(c).cast("string"), F.lit("-")))
    if results is None:
        results = status.sparkSession.createDataFrame([], "file string, setting string, episodes int, accuracy string, balanced string, macro_f1 string")
    both = status.join(results, status["result_md"] == results["file"], "left")
    return both.orderBy("row_idx", "setting").select("row_idx", *[cell(c).alias(c) for c in ("model", "status", "setting", "accuracy", "balanced", "macro_f1", "result_md", "message")])


def model_summary_markdown(spark, path: str) -> str:
    import os

    status = readers.read_status(spark, path)
    files = [r.result_md for r in status.select("result_md").distinct().collect() if r.result_md and os.path.exists(r.result_md)]
    rows = model_summary(status, readers.read_results_md(spark, files) if files else None).collect()
    header = ["Model", "Status", "Setting", "Accuracy", "Balanced Acc", "Macro-F1", "Result", "Message"]
    return "\n".join(["# Model summary", "", *table(header, [list(r)[1:] for r in rows]), ""])


def clean(document):
    """``document`` without NaN or infinity, as JSON has neither."""
    if isinstance(document, dict):
        return {k: clean(v) for k, v in document.items()}
    if isinstance(document, list):
        return [clean(v) for v in document]
    return None if isinstance(document, float) and not math.isfinite(document) else document
