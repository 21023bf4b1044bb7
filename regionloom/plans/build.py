"""Building manifests: from an image tree, and with boxes or masks from heatmaps; the staged pipeline over them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import paths as P
from ..operators import episodes, merge, regions, validate
from ..sources import readers, sinks

MANIFEST_ORDER = ["split", "object_name", "defect_name", "image_path"]


def _no_images(root: str) -> None:
    parts = sorted(n for n in os.listdir(root) if ".tar" in n) if os.path.isdir(root) else []
    if parts:
        raise FileNotFoundError(f"no images below {root}: the archive is not extracted ({', '.join(parts[:5])}); join its parts and unpack them first")
    raise FileNotFoundError(f"no images below {root}")


def image_manifest(spark: SparkSession, root: str, val_ratio: float = 0.15, test_ratio: float = 0.15, seed: int = 42, absolute: bool = False, unannotated: bool = False) -> DataFrame:
    """The canonical manifest of an image tree, in (split, object, defect, path) order with ``row_idx``."""
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    images = readers.crawl_images(spark, root)
    if images.isEmpty():
        _no_images(root)
    jsons = readers._crawl(spark, root).where(F.lower("path").endswith(".json"))
    found = readers.find_annotations(images, jsons)
    if not unannotated:
        found = found.where("annotation is not null")
        if found.isEmpty():
            raise FileNotFoundError(f"no annotated images below {root}: annotations are not extracted, or pass unannotated")
    notes = readers.read_annotations(spark, root, found)
    rows = found.join(notes, "annotation", "left")
    prefix = os.path.abspath(root).rstrip("/") + "/"
    at = lambda c: F.concat(F.lit(prefix), F.col(c)) if absolute else F.col(c)
    defect = P.infer_defect(F.col("relative"), F.col("labels"), os.path.basename(os.path.abspath(root)))
    rows = rows.select(
        at("relative").alias("image_path"), defect.alias("label"), P.infer_split(F.col("relative")).alias("split"), F.lit(None).cast("string").alias("mask_path"),
        P.infer_object(F.col("relative")).alias("object_name"), defect.alias("defect_name"), F.when(F.col("annotation").isNotNull(), at("annotation")).alias("annotation_path"),
        F.coalesce(B.format_box("box"), F.lit("")).alias("bbox"), F.coalesce("polygon_count", F.lit(0)).alias("polygon_count"), "relative",
    )
    # the generator consumes images in path order
    rows = readers.in_order(rows, "relative")
    given, open_ = rows.where("split is not null"), rows.where("split is null")
    if not open_.isEmpty():
        given = given.unionByName(episodes.assign_splits(open_, val_ratio, test_ratio, seed).select(given.columns))
    return readers.in_order(given.drop("row_idx", "relative"), *MANIFEST_ORDER)


def _joined(manifest: DataFrame, heatmaps: DataFrame, missing: str) -> DataFrame:
    rows = merge.lookup(manifest, heatmaps, "image_path", ["heatmap", "image_width", "image_height"])
    if missing == "error":
        merge.fill_missing(rows.select("image_path", "found"), [], "error")
    return rows


def pseudo_boxes(manifest: DataFrame, heatmaps: DataFrame, percentile: float = 0.9, min_area_ratio: float = 0.001, component: str = "max-score", upsample: bool = False, missing: str = "error") -> DataFrame:
    """``manifest`` (row_idx and text columns) with pseudo boxes."""
    rows = _joined(manifest, heatmaps, missing)
    made = regions.heatmap_boxes(rows.where("found").select("row_idx", "heatmap", "image_width", "image_height"), ["row_idx"], percentile, min_area_ratio, component, upsample)
    out = rows.drop("heatmap", "image_width", "image_height").join(made, "row_idx", "left")
    old = F.col("bbox") if "bbox" in manifest.columns else F.lit("")
    source = F.lit("pseudo_heatmap_upsampled" if upsample else "pseudo_heatmap")
    out = out.withColumn("bbox", F.when(F.col("found"), B.format_box("box")).otherwise(old)).withColumn("bbox_source", F.when(F.col("found"), source).otherwise(""))
    out = out.withColumn("pseudo_bbox_score", B.six_decimals("score")).withColumn("pseudo_bbox_area", F.col("area").cast("string"))
    out = out.withColumn("pseudo_bbox_heatmap_processing", F.when(F.col("found"), F.lit("bilinear_to_image" if upsample else "native_grid")).otherwise(""))
    out = merge.fill_missing(out, ["bbox"], missing) if missing != "error" else out
    return out.select(*[c for c in sinks.append_columns(manifest.columns, ["bbox", "bbox_source", "pseudo_bbox_score", "pseudo_bbox_area", "pseudo_bbox_heatmap_processing"])])


def pseudo_masks(manifest: DataFrame, heatmaps: DataFrame, mask_dir: str, percentile: float = 0.9, min_area_ratio: float = 0.001, component: str = "all", upsample: bool = False, missing: str = "error", write: bool = True) -> DataFrame:
    """``manifest`` with masks written below ``mask_dir``, and their boxes."""
    rows = _joined(manifest, heatmaps, missing)
    made = regions.heatmap_masks(rows.where("found").select("row_idx", "image_path", "heatmap", "image_width", "image_height"), ["row_idx", "image_path"], percentile, min_area_ratio, component, upsample)
    made = made.withColumn("made_path", P.mask_path(os.path.abspath(mask_dir), F.col("image_path")))
    if write:
        sinks.write_masks(made.select("made_path", "mask"), "made_path")
    small = made.select("row_idx", "made_path", "box", "score", "area")
    old = lambda c: F.col(c) if c in manifest.columns else F.lit("")
    out = rows.drop("heatmap", "image_width", "image_height").join(small, "row_idx", "left")
    up = "_upsampled" if upsample else ""
    out = out.withColumn("mask_path", F.when(F.col("found"), F.col("made_path")).otherwise(old("mask_path"))).withColumn("bbox", F.when(F.col("found"), B.format_box("box")).otherwise(old("bbox")))
    value = lambda v: F.when(F.col("found"), v).otherwise("")
    out = out.withColumns({"mask_source": value(F.lit("pseudo_heatmap_mask" + up)), "bbox_source": value(F.lit("pseudo_mask_tight_box" + up)), "pseudo_mask_score": B.six_decimals("score"), "pseudo_mask_area": F.col("area").cast("string"), "pseudo_mask_component": value(F.lit(component)), "pseudo_mask_heatmap_processing": value(F.lit("bilinear_to_image" if upsample else "native_grid"))})
    if missing != "error":
        out = merge.fill_missing(merge.fill_missing(out, ["mask_path", "bbox"], missing), [], missing, source="mask_source")
    return out.select(*sinks.append_columns(manifest.columns, ["mask_path", "bbox", "mask_source", "bbox_source", "pseudo_mask_score", "pseudo_mask_area", "pseudo_mask_component", "pseudo_mask_heatmap_processing"]))


#: Environment variables, the settings they give, and the stages that they switch (fixed values).
SETTINGS = {
    "SPLIT": ("split", str),
    "PERCENTILE": ("percentile", float),
    "MIN_AREA_RATIO": ("min_area_ratio", float),
    "MASK_COMPONENT": ("mask_component", str),
    "BBOX_COMPONENT": ("box_component", str),
    "DUPLICATE_POLICY": ("duplicate_policy", str),
    "EVAL_GRID": ("grid", str),
    "Q_QUERIES": ("queries", int),
    "EPISODES": ("episodes", int),
}
SWITCHES = {"VALIDATE_HEATMAPS": "validate", "RUN_PSEUDO_BBOX": "boxes", "RUN_PSEUDO_MASK": "masks", "RUN_CLASSIFICATION": "evaluate"}


@dataclass
class HeatmapPipeline:
    """Merge, validate, dedupe, boxes, masks and evaluation, each stage on or off."""

    spark: SparkSession
    manifest: str
    out: str
    heatmaps: list[str]
    split: str = "test"
    percentile: float = 0.9
    min_area_ratio: float = 0.001
    mask_component: str = "all"
    box_component: str = "max-score"
    duplicate_policy: str = "max"
    grid: str = "5:1,5:3,5:5"
    episodes: int = 100
    queries: int = 5
    stages: tuple[str, ...] = ("merge", "validate", "dedupe", "boxes", "masks", "evaluate")
    features: str | None = None
    results: dict = field(default_factory=dict)

    @classmethod
    def from_env(cls, spark: SparkSession, manifest: str, out: str, heatmaps: list[str], features: str | None = None, env: Mapping[str, str] = os.environ) -> HeatmapPipeline:
        """The pipeline as environment variables ask for it; unset and empty ones leave the defaults."""
        given = {name: made(env[key]) for key, (name, made) in SETTINGS.items() if env.get(key)}
        off = {stage for key, stage in SWITCHES.items() if (env.get(key) or "1") != "1"}
        stages = tuple(s for s in cls.stages if s not in off)
        return cls(spark, manifest, out, heatmaps, stages=stages, features=features, **given)

    def run(self) -> dict:
        from . import evaluation, reports

        spark, r = self.spark, self.results
        path = lambda name: os.path.join(self.out, name)
        maps = readers.load_heatmaps(spark, self.heatmaps, extra=True)
        rows = readers.by_split(readers.read_csv_strict(spark, self.manifest), self.split)
        readers.require(rows, f"no rows of split {self.split}")
        if "validate" in self.stages:
            for file in self.heatmaps:
                r.setdefault("warnings", []).extend(validate.validate_file(spark, file, "allow" if self.duplicate_policy != "error" else "error", require_image_size=False)[1])
        if "dedupe" in self.stages:
            maps = merge.merge_duplicates(maps, self.duplicate_policy)
            sinks.write_jsonl(maps.drop("duplicate_count"), path("heatmaps.jsonl"), ["first_row"], overwrite=True)
            r["heatmaps"] = maps.count()
        if "boxes" in self.stages:
            sinks.write_manifest(pseudo_boxes(rows, maps, self.percentile, self.min_area_ratio, self.box_component), path("pseudo_bbox.csv"), overwrite=True)
        if "masks" in self.stages:
            sinks.write_manifest(pseudo_masks(rows, maps, path("masks"), self.percentile, self.min_area_ratio, self.mask_component), path("pseudo_mask.csv"), overwrite=True)
        if "evaluate" in self.stages and self.features:
            records = readers.normalize_records(rows)
            found = evaluation.records_with_features(records, readers.load_features(spark, self.features))
            grid = [x.asDict() for x in evaluation.few_shot_grid(records, found, self.grid, self.queries, self.episodes).orderBy("setting_idx").collect()]
            r["grid"] = grid
            sinks.write_text(reports.grid_markdown("Few-shot results", {"manifest": self.manifest, "split": self.split}, grid), path("results.md"))
        return r


def run_models(pipelines: dict[str, HeatmapPipeline], summary: str) -> list[str]:
    """Every model's pipeline, going on after a failure; a status line for each."""
    done = []
    for model, pipeline in pipelines.items():
        try:
            if not pipeline.heatmaps or not all(os.path.exists(h) for h in pipeline.heatmaps):
                sinks.append_status(summary, model, "skipped", message="heatmaps are missing")
                continue
            pipeline.run()
            sinks.append_status(summary, model, "ok", os.path.join(pipeline.out, "results.md"))
            done.append(model)
        except Exception as error:  # one model's failure is a result line, not the end of the others
            sinks.append_status(summary, model, "failed", message=str(error).splitlines()[0][:200])
    return done
