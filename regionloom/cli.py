"""Command line: ``python -m regionloom.cli COMMAND ...``; defaults are those of the canonical runs."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .operators import episodes, extract, iou, merge, metrics, validate
from .plans import build, evaluation, reports
from .sources import readers, sinks


def session() -> SparkSession:
    return SparkSession.builder.appName("regionloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _floats(text: str) -> list[float]:
    out = [float(p) for p in text.split(",") if p.strip()]
    if not out:
        raise argparse.ArgumentTypeError("a list of numbers is needed")
    return out


def _names(text: str) -> list[str]:
    return [p.strip() for p in text.split(",") if p.strip()]


def _rows(df, *order) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def build_manifest(spark, a) -> None:
    m = build.image_manifest(spark, a.dataset_root, a.val_ratio, a.test_ratio, a.seed, a.absolute_paths, a.include_unannotated)
    sinks.write_csv(m, a.output, readers.MANIFEST_COLUMNS, ["row_idx"], overwrite=True)
    for r in m.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).orderBy("split").collect():
        print(f"{r.split}: {r.n} rows, {r.labels} labels")


def validate_heatmaps(spark, a) -> None:
    stats, warnings = validate.validate_file(spark, a.heatmap_file, a.duplicate_policy, a.require_image_size, a.max_examples)
    rows = readers.require(readers.by_split(readers.read_csv(spark, a.manifest), a.split), f"no rows of split {a.split}")
    missing, extra = merge.missing_and_extra(rows, stats)
    some = lambda d: ", ".join(r[0] for r in d.orderBy("image_path").limit(a.max_examples).collect())
    n, m = missing.count(), extra.count()
    if n and a.coverage_policy == "error":
        raise SystemExit(f"missing heatmaps: {n}, such as {some(missing)}")
    if n and a.coverage_policy == "warn":
        warnings.append(f"missing_heatmaps={n}; examples={some(missing)}")
    if m:
        warnings.append(f"extra_heatmaps={m}; examples={some(extra)}")
    print(*[f"WARNING {w}" for w in warnings], f"paths={stats.count()} records={stats.agg(F.sum('count')).first()[0]}", sep="\n")


def dedupe_heatmaps(spark, a) -> None:
    maps = readers.load_heatmaps(spark, a.input, extra=True)
    merged = merge.merge_duplicates(maps, a.policy)
    sinks.write_jsonl(merged.drop("first_row") if a.policy == "error" else merged, a.output, ["first_row"] if a.policy != "error" else ["image_path"], a.overwrite)
    print(f"source={maps.count()} unique={merged.count()}")


def _selected(spark, a):
    return readers.require(readers.by_split(readers.read_csv_strict(spark, a.manifest), a.split), f"no rows of split {a.split}")


def pseudo_boxes(spark, a) -> None:
    maps = merge.merge_duplicates(readers.load_heatmaps(spark, a.heatmap_file), a.duplicate_policy)
    out = build.pseudo_boxes(_selected(spark, a), maps, a.percentile, a.min_area_ratio, a.component, a.upsample_to_image, a.missing_policy)
    sinks.write_manifest(out, a.output, overwrite=a.overwrite)


def pseudo_masks(spark, a) -> None:
    maps = merge.merge_duplicates(readers.load_heatmaps(spark, a.heatmap_file), "max")
    sinks.guard(a.output, a.overwrite)
    out = build.pseudo_masks(_selected(spark, a), maps, a.mask_dir, a.percentile, a.min_area_ratio, a.component, a.upsample_to_image, a.missing_policy)
    sinks.write_manifest(out, a.output, overwrite=a.overwrite)


def evaluate_boxes(spark, a) -> None:
    truth = readers.by_split(readers.read_csv(spark, a.gt_manifest), a.split)
    measured = iou.compare(truth, readers.read_csv(spark, a.pseudo_manifest))
    summary = iou.summarize(measured).first().asDict()
    worst = _rows(iou.worst(measured, 10).select("image_path", "iou"), "iou", "image_path")
    document = {"gt_manifest": a.gt_manifest, "pseudo_manifest": a.pseudo_manifest, "split": a.split, **reports.iou_document(summary, worst)}
    print(json.dumps(document, indent=2, sort_keys=True))
    if a.output_json:
        sinks.write_json(document, a.output_json)
    if a.output_md:
        sinks.write_text(reports.iou_markdown(document), a.output_md)
    if a.output_csv:
        rows = evaluation.per_image(measured)
        sinks.write_csv(rows, a.output_csv, [c for c in rows.columns if c != "row_idx"], ["row_idx"], overwrite=True)


def sweep_boxes(spark, a) -> None:
    source = readers.by_split(readers.read_csv_strict(spark, a.manifest), a.split)
    maps = merge.merge_duplicates(readers.load_heatmaps(spark, a.heatmap_file), "max")
    ranked, measured = evaluation.box_sweep(source, maps, a.percentiles, a.min_area_ratios, a.components, a.missing_policy, a.upsample_to_image)
    results = _rows(ranked, "rank")
    facts = {"gt_manifest": a.manifest, "heatmap_file": a.heatmap_file, "split": a.split, "percentiles": a.percentiles, "min_area_ratios": a.min_area_ratios, "components": a.components, "missing_policy": a.missing_policy, "ranking_metric": "mean_iou_then_recall"}
    names = {r["setting_idx"]: os.path.join(a.output_manifest_dir, reports.setting_file(a.upsample_to_image, r["percentile"], r["min_area_ratio"], r["component"])) for r in results} if a.output_manifest_dir else {}
    if a.output_json:
        sinks.write_json(reports.clean({**facts, "best": results[0] if results else None, "results": results}), a.output_json)
    if a.output_md:
        sinks.write_text(reports.sweep_markdown(results), a.output_md)
    if a.output_csv:
        rows = evaluation.sweep_rows(ranked, a.upsample_to_image)
        path = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("setting_idx")) if names else F.lit("")
        sinks.write_csv(rows.withColumn("pseudo_manifest", path), a.output_csv, [*[c for c in rows.columns if c != "setting_idx"], "pseudo_manifest"], ["rank"], overwrite=True)
    if names:
        measured = measured.persist()
        for r in results:
            sinks.write_manifest(evaluation.sweep_manifest(measured, source.columns, r, a.upsample_to_image), names[r["setting_idx"]], overwrite=True)
    print(reports.sweep_markdown(results))


def fuse_features(spark, a) -> None:
    whole, region = (readers.load_fusion_cache(spark, p) for p in (a.whole_features, a.region_features))
    sinks.write_jsonl(merge.fuse_caches(whole, region, a.method, a.alpha, a.normalize_input, a.normalize_output), a.output, ["image_path"], a.overwrite)


def _features(spark, a, records, path):
    if a.feature_source == "cached":
        return evaluation.records_with_features(records, readers.load_features(spark, path), a.feature_dim)
    if a.feature_source == "hash":
        return records.select("row_idx", episodes.hash_features(F.col("image_path"), F.col("label"), a.hash_salt, a.feature_dim).alias("feature"))
    return records.select("row_idx", V.parse_spaced(F.element_at("metadata", F.lit("feature"))).alias("feature"))


def few_shot(spark, a) -> None:
    records = evaluation.load_split(spark, a.manifest, a.split)
    found = _features(spark, a, records, a.feature_file)
    results = _rows(evaluation.few_shot_grid(records, found, a.grid, a.q_queries, a.episodes, a.seed), "setting_idx")
    _report(a, results, {"manifest": a.manifest, "split": a.split, "features": a.feature_file or a.feature_source})


def region_context(spark, a) -> None:
    records = evaluation.load_split(spark, a.manifest, a.split)
    whole = evaluation.records_with_features(records, readers.load_features(spark, a.whole_feature_file), a.whole_dim)
    region = evaluation.records_with_features(records, readers.load_features(spark, a.region_feature_file), a.region_dim)
    results = _rows(evaluation.region_context_grid(records, whole, region, a.whole_weights, a.grid, a.q_queries, a.episodes, a.seed), "weight_idx", "setting_idx")
    _report(a, results, {"manifest": a.manifest, "split": a.split}, "+/-", True)


def _report(a, results, facts, sign="±", weights=False) -> None:
    text = reports.grid_markdown("Few-shot results", facts, results, sign, weights)
    if a.output_json:
        sinks.write_json(reports.grid_document(facts, results), a.output_json)
    if a.output_md:
        sinks.write_text(text, a.output_md)
    print(text)


def confusion(spark, a) -> None:
    records = evaluation.load_split(spark, a.manifest, a.split)
    of = lambda path, dim: evaluation.records_with_features(records, readers.load_features(spark, path), dim)
    baseline = of(a.baseline_feature_file, a.baseline_dim) if a.baseline_feature_file else None
    parts = evaluation.confusion_analysis(records, of(a.whole_feature_file, a.whole_dim), of(a.region_feature_file, a.region_dim), a.n_way, a.k_shot, baseline, a.whole_weight, a.q_queries, a.episodes, a.seed, a.top_k)
    overall = _rows(parts["overall"], "model")
    deltas = _rows(parts["deltas"], *metrics.delta_order()) if "deltas" in parts else []
    confusions = _rows(parts["confusions"], "model", "rank")
    sinks.write_json({"overall": overall, "per_class_delta": deltas, "top_confusions": confusions}, a.output_json) if a.output_json else None
    sinks.write_csv(parts["deltas"], a.output_per_class_csv, order=metrics.delta_order(), overwrite=True) if "deltas" in parts and a.output_per_class_csv else sinks.write_csv(parts["per_class"].drop("model"), a.output_per_class_csv, order=["label"], overwrite=True) if a.output_per_class_csv else None
    sinks.write_csv(parts["confusions"].withColumnsRenamed({"y_true": "true", "y_pred": "pred"}), a.output_confusion_csv, ["model", "true", "pred", "count", "fraction_of_true"], [F.desc("model"), "rank"], overwrite=True) if a.output_confusion_csv else None
    text = reports.confusion_markdown(overall, deltas, confusions)
    sinks.write_text(text, a.output_md) if a.output_md else None
    print(text)


def _plugin(name: str):
    """'module:function' -> the function; its module goes to the executors by value, as this package does."""
    import importlib

    from pyspark import cloudpickle

    module, _, function = name.partition(":")
    found = importlib.import_module(module)
    cloudpickle.register_pickle_by_value(found)
    return getattr(found, function)


def _images(spark, a):
    records = evaluation.load_split(spark, a.manifest, a.split) if a.split != "all" else readers.require(readers.load_manifest(spark, a.manifest), "no rows")
    records = records.where(F.col("row_idx") < F.lit(a.limit)) if a.limit and a.split == "all" else records.orderBy("row_idx").limit(a.limit) if a.limit else records
    return extract.open_images(spark, records, a.image_root)


def extract_features(spark, a) -> None:
    box = F.element_at("metadata", F.lit("bbox"))
    records = _images(spark, a).withColumns({"region": F.lit(a.region), "bbox": box, "padding": F.lit(a.bbox_padding), "min_crop_size": F.lit(a.min_crop_size), "mask_background": F.lit(a.mask_background)})
    made = extract.extract_features(records, _plugin(a.plugin), a.feature_dim)
    sinks.write_jsonl(made.select("image_path", "label", "split", "object_name", "defect_name", "region", "feature"), a.output, ["image_path"], a.overwrite)


def extract_heatmaps(spark, a) -> None:
    """The plug-in gives the patch tokens of an image; scores are made here."""
    records = _images(spark, a)
    tokens = extract.extract_tokens(records, _plugin(a.plugin)).persist()
    keys = ["image_path", "label", "split", "object_name", "defect_name"]
    if a.mode == "patch-contrast":
        maps = extract.heatmaps_from_tokens(tokens, keys)
    else:
        chosen = episodes.select_memory(evaluation.load_split(spark, a.manifest, a.memory_split), a.memory_split, episodes.parse_label_set(a.memory_labels), a.max_memory_images, a.seed)
        memory = extract.extract_tokens(extract.open_images(spark, chosen, a.image_root), _plugin(a.plugin))
        maps = extract.heatmaps_from_memory(tokens, memory, keys, a.max_memory_patches, a.seed)
    maps = maps.withColumns({"heatmap_width": F.size(F.col("heatmap")[0]), "heatmap_height": F.size("heatmap"), "localizer": F.lit(a.mode), "score_normalization": F.lit("min-max")})
    sinks.write_jsonl(maps, a.output, ["image_path"], a.overwrite)


def summarize_models(spark, a) -> None:
    sinks.write_text(reports.model_summary_markdown(spark, a.summary_jsonl), a.output_md)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="regionloom", description=__doc__)
    subs = top.add_subparsers(dest="command", required=True)

    def command(name, run, *arguments):
        sub = subs.add_parser(name)
        sub.set_defaults(run=run)
        for flag, options in arguments:
            sub.add_argument(flag, **options)

    must = lambda flag: (flag, {"required": True})
    text = lambda flag, default=None: (flag, {"default": default})
    whole = lambda flag, default=None: (flag, {"type": int, "default": default})
    number = lambda flag, default: (flag, {"type": float, "default": default})
    on = lambda flag: (flag, {"action": "store_true"})
    one = lambda flag, choices, default: (flag, {"choices": choices, "default": default})
    many = lambda flag, kind, default: (flag, {"type": kind, "default": default})
    missing = one("--missing-policy", ["error", "clear", "keep"], "error")
    outputs = [text(f"--output-{k}") for k in ("json", "md", "csv")]
    regions = [must("--manifest"), must("--heatmap-file"), must("--output"), text("--split", "all"), number("--percentile", 0.9), number("--min-area-ratio", 0.001), on("--upsample-to-image"), missing, on("--overwrite")]
    grid = [must("--manifest"), text("--split", "train"), whole("--q-queries", 5), whole("--seed", 42), text("--output-json"), text("--output-md")]
    command("build-manifest", build_manifest, must("--dataset-root"), must("--output"), number("--val-ratio", 0.15), number("--test-ratio", 0.15), whole("--seed", 42), on("--absolute-paths"), on("--include-unannotated"))
    command("validate-heatmaps", validate_heatmaps, must("--heatmap-file"), must("--manifest"), text("--split", "all"), one("--coverage-policy", ["error", "warn", "ignore"], "error"), one("--duplicate-policy", list(validate.POLICIES), "allow"), ("--require-image-size", {"action": argparse.BooleanOptionalAction, "default": True}), whole("--max-examples", 8))
    command("dedupe-heatmaps", dedupe_heatmaps, must("--input"), must("--output"), one("--policy", list(merge.POLICIES), "max"), on("--overwrite"))
    command("pseudo-boxes", pseudo_boxes, *regions, one("--component", ["largest", "max-score"], "max-score"), one("--duplicate-policy", list(merge.POLICIES), "max"))
    command("pseudo-masks", pseudo_masks, *regions, must("--mask-dir"), one("--component", ["all", "largest", "max-score"], "all"))
    command("evaluate-boxes", evaluate_boxes, must("--gt-manifest"), must("--pseudo-manifest"), text("--split", "train"), *outputs)
    command("sweep-boxes", sweep_boxes, must("--manifest"), must("--heatmap-file"), text("--split", "train"), many("--percentiles", _floats, [0.85, 0.90, 0.95]), many("--min-area-ratios", _floats, [0.0005, 0.001, 0.005]), many("--components", _names, ["largest", "max-score"]), one("--missing-policy", ["error", "skip"], "error"), on("--upsample-to-image"), text("--output-manifest-dir"), *outputs)
    command("fuse-features", fuse_features, must("--whole-features"), must("--region-features"), must("--output"), one("--method", ["concat", "weighted-sum"], "concat"), number("--alpha", 0.5), on("--normalize-input"), on("--normalize-output"), on("--overwrite"))
    source = [one("--feature-source", ["metadata", "hash", "cached"], "cached"), text("--feature-file"), text("--hash-salt", "")]
    command("few-shot", few_shot, *grid, *source, text("--grid", evaluation.GRID), whole("--episodes", 200), whole("--feature-dim", 384))
    command("prototype-baseline", few_shot, *grid, one("--feature-source", ["metadata", "hash", "cached"], "metadata"), text("--feature-file"), text("--hash-salt", ""), text("--grid", "5:1"), whole("--episodes", 100), whole("--feature-dim", 64))
    branches = [must("--whole-feature-file"), must("--region-feature-file"), whole("--whole-dim", 384), whole("--region-dim", 384), whole("--episodes", 200)]
    command("region-context", region_context, *grid, *branches, text("--grid", evaluation.GRID), many("--whole-weights", _floats, [0.5]))
    command("confusion", confusion, *grid, *branches, ("--n-way", {"type": int, "required": True}), ("--k-shot", {"type": int, "required": True}), text("--baseline-feature-file"), whole("--baseline-dim", 768), number("--whole-weight", 0.75), whole("--top-k", 20), text("--output-per-class-csv"), text("--output-confusion-csv"))
    images = [must("--manifest"), must("--image-root"), must("--output"), must("--plugin"), text("--split", "train"), whole("--limit", 0), on("--overwrite")]
    command("extract-features", extract_features, *images, one("--region", ["whole", "bbox", "mask"], "whole"), number("--bbox-padding", 0.15), whole("--min-crop-size", 32), one("--mask-background", ["black", "keep"], "black"), whole("--feature-dim"))
    command("extract-heatmaps", extract_heatmaps, *images, one("--mode", ["patch-contrast", "nearest-memory"], "patch-contrast"), text("--memory-split", "train"), text("--memory-labels", "good,normal,ok"), whole("--max-memory-images", 200), whole("--max-memory-patches", 20000), whole("--seed", 42))
    command("summarize-models", summarize_models, must("--summary-jsonl"), must("--output-md"))
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(session(), a)


if __name__ == "__main__":
    main()
