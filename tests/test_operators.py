import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionloom.operators import classify, episodes, iou, merge, metrics, regions, validate
from regionloom.plans import build, evaluation, reports
from regionloom.sources import readers, sinks

H1 = [[0.0, 0.1, 0.0, 0.0], [0.0, 0.8, 0.9, 0.0], [0.0, 0.7, 0.6, 0.0], [0.0, 0.0, 0.0, 0.0]]
H2 = [[0.0, 0.0], [0.0, 1.0]]
MAPS = "row_idx long, image_path string, heatmap array<array<double>>, image_width int, image_height int"


def maps(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], MAPS)


def test_boxes_from_heatmaps(spark):
    r = regions.heatmap_boxes(maps(spark, ("a", H1, 40, 40)), ["image_path"], 0.75, 0.01, "max-score").first()
    assert tuple(r.box) == (10, 10, 30, 30) and r.area == 4 and round(r.score, 9) == 0.75
    m = maps(spark, ("a", H2, 4, 4))
    assert tuple(regions.heatmap_boxes(m, ["image_path"], 1.0, 0.0).first().box) == (2, 2, 4, 4)
    assert tuple(regions.heatmap_boxes(m, ["image_path"], 1.0, 0.0, upsample=True).first().box) == (3, 3, 4, 4)
    # all components too small: the peak stands in
    p = regions.heatmap_boxes(maps(spark, ("a", H1, None, None)), ["image_path"], 0.75, 0.9).first()
    assert tuple(p.box) == (2, 1, 3, 2) and p.area == 1


def test_masks_from_heatmaps(spark):
    r = regions.heatmap_masks(maps(spark, ("a", H1, 40, 40)), ["image_path"], 0.75, 0.01, "max-score").first()
    assert tuple(r.box) == (10, 10, 30, 30) and r.area == 400
    m = maps(spark, ("a", H2, 4, 4))
    assert regions.heatmap_masks(m, ["image_path"], 1.0, 0.0).first().area == 4
    assert regions.heatmap_masks(m, ["image_path"], 1.0, 0.0, upsample=True).first().area == 1
    two = [[1.0, 0.0, 0.9], [0.0, 0.0, 0.9]]
    assert regions.heatmap_masks(maps(spark, ("a", two, 3, 2)), ["image_path"], 0.5, 0.0, "all").first().area == 3
    assert regions.heatmap_masks(maps(spark, ("a", two, 3, 2)), ["image_path"], 0.5, 0.0, "largest").first().area == 2


def test_components_match_flood_fill():
    rng = np.random.default_rng(0)
    for _ in range(60):
        mask = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.5
        labels, n = regions.label_components(mask)
        want, k = np.zeros(mask.shape, int), 0
        for y, x in zip(*np.nonzero(mask), strict=True):
            if want[y, x]:
                continue
            k += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not want[a, b]:
                    want[a, b] = k
                    todo += [(a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)]
        assert n == k and (labels == want).all()


def test_merge_policies(spark):
    two = maps(spark, ("a", [[0.0, 0.2], [0.1, 0.0]], None, 5), ("a", [[0.3, 0.1], [0.4, 0.5]], 4, None))
    get = lambda p: merge.merge_duplicates(two, p).first()
    m = get("max")
    assert m.heatmap == [[0.3, 0.2], [0.4, 0.5]] and m.duplicate_count == 2 and (m.image_width, m.image_height) == (4, 5)
    assert get("first").heatmap == [[0.0, 0.2], [0.1, 0.0]] and get("last").heatmap == [[0.3, 0.1], [0.4, 0.5]]
    with pytest.raises(Exception, match="repeated"):
        merge.merge_duplicates(two, "error").collect()
    with pytest.raises(Exception, match="conflicting"):
        merge.merge_duplicates(maps(spark, ("a", H2, 3, 3), ("a", H2, 4, 3)), "max").collect()
    with pytest.raises(Exception, match="unequal"):
        merge.merge_duplicates(maps(spark, ("a", H2, 3, 3), ("a", H1, 3, 3)), "max").collect()


def test_lookup_and_policies(spark):
    probe = spark.createDataFrame([(0, "a\\b"), (1, "c"), (2, "d")], "row_idx int, image_path string")
    stored = spark.createDataFrame([("a/b", 1), ("c", 2), ("c", 3)], "image_path string, value int")
    got = merge.lookup(probe, stored.withColumn("o", F.col("value")), "image_path", ["value"], order="o").orderBy("row_idx").collect()
    assert [(r.value, r.found) for r in got] == [(1, True), (3, True), (None, False)]
    with pytest.raises(ValueError, match="missing heatmaps for 1 rows"):
        merge.fill_missing(merge.lookup(probe, stored, "image_path", ["value"]), [], "error")


def test_iou_evaluation(spark):
    truth = spark.createDataFrame([(0, "a", "0,0,10,10")], "row_idx int, image_path string, bbox string")
    pseudo = spark.createDataFrame([(0, "a", "5,5,15,15")], "row_idx int, image_path string, bbox string")
    s = iou.summarize(iou.compare(truth, pseudo)).first()
    assert s.gt_rows == s.matched_rows == 1 and round(s.iou_mean, 4) == 0.1429 and s.iou_stdev == 0
    empty = iou.summarize(iou.compare(truth, pseudo.where("false"))).first()
    assert empty.missing_pseudo_rows == 1 and empty.iou_mean is None and empty.recall_50 is None


def test_sweep(spark):
    manifest = spark.createDataFrame([(0, "a", "10,10,30,30")], "row_idx long, image_path string, bbox string")
    ranked, _ = evaluation.box_sweep(manifest, maps(spark, ("a", H1, 40, 40)).drop("row_idx"), [0.75, 0.95], [0.0], ["max-score"], upsample=True)
    best = ranked.where("rank = 1").first()
    assert best.percentile == 0.75 and 0.8 < best.iou_mean < 0.9 and ranked.count() == 2
    assert reports.setting_file(True, 0.75, 0.0005, "largest") == "pseudo_bbox_upsampled_p0p75_area0p0005_largest.csv"


def test_episode_draws_replay_the_generator(spark):
    labels = [(i, f"c{i % 4}") for i in range(40)]
    records = spark.createDataFrame(labels, "row_idx long, label string")
    got = defaultdict(list)
    for r in episodes.sample(records, [(3, 2)], 3, 2, 7).orderBy("episode_idx", "role", "pos").collect():
        got[r.episode_idx, r.role].append(r.row_idx)
    for e in range(3):
        rng = random.Random(7 + e)
        groups = defaultdict(list)
        for i, c in labels:
            groups[c].append(i)
        support, query = [], []
        for c in rng.sample(sorted(groups), 3):
            rng.shuffle(items := list(groups[c]))
            support += items[:2]
            query += items[2:4]
        rng.shuffle(support)
        rng.shuffle(query)
        assert got[e, "support"] == support and got[e, "query"] == query
    with pytest.raises(ValueError):
        episodes.draw({"a": [1]}, 2, 1, 1, 0)


def test_grids_classify_and_fuse(spark):
    centers = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [-1.0, 0.0]}
    rows = [(i, c, [x + 0.01 * i for x in v]) for i, (c, v) in enumerate((c, v) for c, v in centers.items() for _ in range(5))]
    f = spark.createDataFrame(rows, "row_idx long, label string, feature array<double>")
    grid = evaluation.few_shot_grid(f, f, "3:2", 2, 4, 1).first()
    assert grid.accuracy_mean == 1 and grid.macro_f1_mean == 1 and grid.accuracy_stdev == 0
    fused = evaluation.region_context_grid(f, f, f, [0.0, 1.0], "3:2", 2, 2, 7).collect()
    assert len(fused) == 2 and all(r.accuracy_mean == 1 for r in fused)
    parts = evaluation.confusion_analysis(f, f, f, 3, 2, baseline=f, queries=2, count=4)
    assert parts["confusions"].count() == 0 and parts["deltas"].count() == 3 and all(r.accuracy == 1 for r in parts["overall"].collect())


def test_episode_scores_match_plain_cosine(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 6))
    f = spark.createDataFrame([(i, f"c{i % 3}", x[i].tolist()) for i in range(30)], "row_idx long, label string, feature array<double>")
    drawn = episodes.sample(f, [(3, 2)], 2, 3, 5)
    got = {(r.episode_idx, r.pos, r["class"]): r.score for r in classify.episode_scores(drawn, f, ["setting_idx", "episode_idx"]).collect()}
    rows = defaultdict(list)
    for r in drawn.collect():
        rows[r.episode_idx, r.role].append(r)
    for e in range(2):
        means = {c: np.mean([x[r.row_idx] for r in rows[e, "support"] if r.label == c], axis=0) for c in {r.label for r in rows[e, "support"]}}
        for q in rows[e, "query"]:
            for c, m in means.items():
                want = x[q.row_idx] @ m / np.linalg.norm(x[q.row_idx]) / np.linalg.norm(m)
                assert abs(got[e, q.pos, c] - want) < 1e-12


def test_metrics(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "z"), ("c", "c")]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], "at int, y_true string, y_pred string")
    cells = metrics.confusion(p, order="at")
    s = metrics.scores(cells).first()
    assert s.accuracy == 0.6 and round(s.balanced_accuracy, 9) == round((0.5 + 0.5 + 1) / 3, 9)
    count = Counter(pairs)
    f1 = []
    for label in "abcz":
        tp, t, q = count[label, label], sum(n for (a, _), n in count.items() if a == label), sum(n for (_, b), n in count.items() if b == label)
        f1.append(2 * tp / (t + q))
    assert round(s.macro_f1, 9) == round(sum(f1) / 4, 9)
    assert [(r.y_true, r.y_pred) for r in metrics.top_confusions(cells, k=5).orderBy("rank").collect()] == [("a", "b"), ("b", "z")]
    empty = metrics.scores(metrics.confusion(p.where("false"))).first()
    assert (empty.accuracy, empty.balanced_accuracy, empty.macro_f1) == (0, 0, 0)
    with pytest.raises(ValueError):
        classify.normalized_weights(0, 0)


def test_validation(spark, tmp_path):
    good = {"image_path": "a\\b", "heatmap": [[1, 2], [3, 4]], "image_width": "9.0", "image_height": 9}
    lines = [json.dumps(good), "", "{", "3", json.dumps({**good, "image_path": " "}), json.dumps({**good, "heatmap": [[]]}), json.dumps({**good, "heatmap": [[1], [1, 2]]}), json.dumps({**good, "heatmap": [[1, True]]}), json.dumps({**good, "heatmap": [[1, float("nan")]]}), json.dumps({**good, "heatmap_height": 3}), json.dumps({**good, "image_width": 0}), json.dumps({k: v for k, v in good.items() if k != "image_width"}), json.dumps({**good, "heatmap": [[1]]})]
    df = spark.createDataFrame(list(enumerate(lines)), "row_idx long, value string")
    got = [r.error for r in validate.with_duplicates(validate.report(df)).orderBy("row_idx").collect()]
    assert got[:4] == [None, "invalid_json", "not_an_object", "missing_image_path"]
    assert got[4:6] == ["empty_rows", "ragged_rows"] and got[6] == "not_finite_numeric" and got[7] in ("not_finite_numeric", "invalid_json")
    assert got[8:] == ["heatmap_height_mismatch", "bad_image_width", "missing_image_size", "duplicate_heatmap_size"]
    path = tmp_path / "h.jsonl"
    path.write_text("\n".join([lines[0], "", lines[0]]) + "\n")
    stats, warnings = validate.validate_file(spark, str(path), "max")
    assert stats.first()["count"] == 2 and len(warnings) == 2
    with pytest.raises(ValueError, match="duplicate_image_path"):
        validate.validate_file(spark, str(path), "error")


def test_manifest_of_a_tree(spark, tmp_path):
    folder = tmp_path / "bottle" / "broken_large"
    folder.mkdir(parents=True)
    for i in range(4):
        (folder / f"sample_{i}.png").write_bytes(b"x")
        (folder / f"sample_{i}.json").write_text(json.dumps({"shapes": [{"label": "broken large", "points": [[1, 2], [5, 7]]}, 3]}))
    m = build.image_manifest(spark, str(tmp_path), 0.25, 0.25)
    rows = m.collect()
    assert len(rows) == 4 and {(r.label, r.object_name, r.bbox, r.polygon_count) for r in rows} == {("broken_large", "bottle", "1.00,2.00,5.00,7.00", 2)}
    assert Counter(r.split for r in rows) == {"test": 1, "val": 1, "train": 2}
    other = tmp_path / "none"
    other.mkdir()
    (other / "image.tar.001").write_bytes(b"x")
    with pytest.raises(FileNotFoundError, match="not extracted"):
        build.image_manifest(spark, str(other))


def test_pipeline_and_commands(spark, tmp_path):
    from regionloom import cli

    rows = "image_path,label,split,bbox\n" + "".join(f'{c}{i}.png,{c},test,"10,10,30,30"\n' for c in "abc" for i in range(4))
    (tmp_path / "m.csv").write_text(rows)
    (tmp_path / "h.jsonl").write_text("".join(json.dumps({"image_path": f"{c}{i}.png", "heatmap": H1, "image_width": 40, "image_height": 40}) + "\n" for c in "abc" for i in range(4)))
    hot = {"a": [1, 0, 0], "b": [0, 1, 0], "c": [0, 0, 1]}
    (tmp_path / "f.jsonl").write_text("".join(json.dumps({"image_path": f"{c}{i}.png", "feature": hot[c]}) + "\n" for c in "abc" for i in range(4)))
    at = lambda n: str(tmp_path / n)
    p = build.HeatmapPipeline(spark, at("m.csv"), at("out"), [at("h.jsonl")], percentile=0.75, grid="3:1", episodes=2, features=at("f.jsonl"))
    p.grid = "3:1"
    with pytest.raises(Exception, match="rows"):  # five queries and one shot need six rows of a class
        p.run()
    boxes = readers.read_csv(spark, at("out/pseudo_bbox.csv"))
    assert {r.bbox for r in boxes.collect()} == {"10.00,10.00,30.00,30.00"}
    masks = readers.read_csv(spark, at("out/pseudo_mask.csv")).collect()
    assert all(r.bbox == "10.00,10.00,30.00,30.00" and r.pseudo_mask_area == "400" for r in masks)
    assert open(masks[0].mask_path, "rb").read(8) == b"\x89PNG\r\n\x1a\n"
    cli.main(["evaluate-boxes", "--gt-manifest", at("m.csv"), "--pseudo-manifest", at("out/pseudo_bbox.csv"), "--split", "test", "--output-json", at("iou.json")])
    assert json.load(open(at("iou.json")))["iou"]["mean"] == 1
    cli.main(["evaluate-boxes", "--gt-manifest", at("m.csv"), "--pseudo-manifest", at("out/pseudo_mask.csv"), "--split", "test", "--output-csv", at("iou.csv")])
    assert open(at("iou.csv")).readline().strip() == "image_path,label,split,object_name,defect_name,gt_bbox,pseudo_bbox,iou,gt_area,pseudo_area,area_ratio,bbox_source,pseudo_bbox_score,pseudo_bbox_area"
    cli.main(["sweep-boxes", "--manifest", at("m.csv"), "--heatmap-file", at("h.jsonl"), "--split", "test", "--percentiles", "0.75", "--min-area-ratios", "0.01", "--output-csv", at("sweep.csv"), "--output-json", at("sweep.json"), "--output-manifest-dir", at("sweep")])
    head, first = open(at("sweep.csv")).read().splitlines()[:2]
    assert head.startswith("rank,percentile,min_area_ratio,component,heatmap_processing,gt_rows,matched_heatmap_rows,evaluated_rows,missing_heatmap_rows,invalid_gt_bbox_rows,mean_iou,median_iou,recall_iou_025,recall_iou_050,mean_area_ratio,pseudo_manifest")
    assert first.startswith("1,0.75,0.01,largest,native_grid,12,12,12,0,0,1.0") and len(list((tmp_path / "sweep").iterdir())) == 2
    swept = readers.read_csv(spark, at("sweep/pseudo_bbox_native_p0p75_area0p01_largest.csv")).first()
    assert swept.bbox == "10.00,10.00,30.00,30.00" and swept.pseudo_bbox_score == "0.750000" and swept.bbox_source == "pseudo_heatmap_sweep"
    cli.main(["confusion", "--manifest", at("m.csv"), "--split", "test", "--whole-feature-file", at("f.jsonl"), "--region-feature-file", at("f.jsonl"), "--baseline-feature-file", at("f.jsonl"), "--whole-dim", "3", "--region-dim", "3", "--baseline-dim", "3", "--n-way", "3", "--k-shot", "1", "--q-queries", "2", "--episodes", "2", "--output-per-class-csv", at("pc.csv"), "--output-confusion-csv", at("cf.csv"), "--output-md", at("cf.md")])
    assert open(at("cf.csv")).read().strip() == "model,true,pred,count,fraction_of_true" and len(open(at("pc.csv")).readlines()) == 4
    cli.main(["few-shot", "--manifest", at("m.csv"), "--split", "test", "--feature-file", at("f.jsonl"), "--feature-dim", "3", "--grid", "3:1", "--q-queries", "2", "--episodes", "3", "--output-md", at("r.md")])
    assert "100.00 ± 0.00" in open(at("r.md")).read()
    build.run_models({"x": build.HeatmapPipeline(spark, at("m.csv"), at("o2"), [at("missing.jsonl")])}, at("s.jsonl"))
    sinks.append_status(at("s.jsonl"), "y|z", "ok", at("r.md"))
    cli.main(["summarize-models", "--summary-jsonl", at("s.jsonl"), "--output-md", at("s.md")])
    text = open(at("s.md")).read()
    assert "| x | skipped | - |" in text and "y\\|z" in text and "3-way 1-shot" in text
    with pytest.raises(FileExistsError):
        sinks.guard(at("s.md"))


def test_readers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"image_path": "a", "label": "x", "split": "", "extra": 3}\n\n{"image_path": "b", "label": "y", "mask_path": ""}\n')
    rows = readers.load_manifest(spark, str(tmp_path / "m.jsonl")).orderBy("row_idx").collect()
    assert [(r.split, r.mask_path, r.metadata.get("extra")) for r in rows] == [("train", None, "3"), ("train", None, None)]
    (tmp_path / "bad.jsonl").write_text('{"image_path": "a", "label": "x"}\n{oops\n')
    with pytest.raises(Exception, match="invalid JSON"):
        readers.load_manifest(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "f.csv").write_text('image_path,feature\na,"[1, 2]"\na,"3 4"\n')
    assert readers.load_features(spark, str(tmp_path / "f.csv")).first().feature == [3, 4]
    with pytest.raises(ValueError):
        readers.load_manifest(spark, "x.txt")


def test_stream(spark, tmp_path):
    from regionloom.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps({"image_path": "a", "heatmap": H1, "image_width": "40", "image_height": "40"}) + "\n" + json.dumps({"image_path": "b", "heatmap": [[1], []]}) + "\n")
    stream = ingest.start_boxes(ingest.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), 0.75, 0.01)
    stream.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.image_path, tuple(r.box)) for r in got] == [("a", (10, 10, 30, 30))]


def test_plug_ins(spark, tmp_path):
    from regionloom.operators import extract

    def image_size_plugin(pdf):
        return [[float(len(c)), 1.0] for c in pdf["content"]]

    for i in range(3):
        (tmp_path / f"{i}.png").write_bytes(b"x" * (i + 1))
    records = spark.createDataFrame([(f"{i}.png", "l") for i in range(3)], "image_path string, label string")
    found = extract.open_images(spark, records, str(tmp_path))
    got = {r.image_path: r.feature for r in extract.extract_features(found, image_size_plugin, 2).collect()}
    assert got == {f"{i}.png": [i + 1.0, 1.0] for i in range(3)}
    with pytest.raises(Exception, match="no image"):
        extract.open_images(spark, spark.createDataFrame([("z.png",)], "image_path string"), str(tmp_path)).collect()
    tokens = spark.createDataFrame([("a", [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 0.1]])], "image_path string, tokens array<array<double>>")
    grid = extract.heatmaps_from_tokens(tokens, ["image_path"]).first().heatmap
    assert grid[0][1] == 1 and min(min(r) for r in grid) == 0
    near = extract.heatmaps_from_memory(tokens, tokens.select("image_path", F.slice("tokens", 1, 1).alias("tokens")), ["image_path"]).first().heatmap
    assert near[0] == [0, 1] and near[1][0] == 0
    pixels, mask = np.arange(36).reshape(6, 6), np.zeros((6, 6), bool)
    mask[1:3, 2:4] = True
    column = F.array(*[F.array(*[F.lit(bool(v)) for v in r]) for r in mask])
    crop = tuple(spark.range(1).select(extract.mask_crop(column, 0.5, 1).alias("c")).first().c)
    assert crop == (1, 0, 5, 4)
    part = extract.apply_crop(pixels, mask, crop)
    assert part.shape == (4, 4) and part[0, 0] == 0 and part[1, 1] == pixels[1, 2] and extract.apply_crop(pixels, mask, crop, "keep")[0, 0] == pixels[0, 1]


def test_posix_form_of_paths(spark):
    probe = spark.createDataFrame([(0, ".\\a\\\\b"), (1, "a/b/")], "row_idx int, image_path string")
    stored = spark.createDataFrame([("a/b", 1)], "image_path string, value int")
    assert [r.value for r in merge.lookup(probe, stored, "image_path", ["value"]).orderBy("row_idx").collect()] == [1, 1]


def test_nearest_memory_in_blocks(spark, monkeypatch):
    """Every token against every memory vector, whatever the blocks; repeated keys and an empty memory keep their rows."""
    rng = np.random.default_rng(3)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(n, 8)))
    q, m = unit(150), unit(90)
    tokens = spark.createDataFrame([(f"i{i // 8}", i % 8, v.tolist()) for i, v in enumerate(q)] + [("i0", 0, q[0].tolist())], "name string, patch int, token array<double>")
    memory = spark.createDataFrame([(v.tolist(),) for v in m] + [(None,)], "token array<double>")
    want = sorted([(f"i{i // 8}", i % 8, round(1 - (m @ v).max(), 9)) for i, v in enumerate(q)] + [("i0", 0, round(1 - (m @ q[0]).max(), 9))])
    for block in (classify.BLOCK, 8 * 7):
        monkeypatch.setattr(classify, "BLOCK", block)
        for most in ("10485760", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            try:
                got = classify.nearest_memory(tokens, memory, ["name", "patch"]).collect()
            finally:
                spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            assert sorted((r.name, r.patch, round(r.score, 9)) for r in got) == want
    assert [r.score for r in classify.nearest_memory(tokens, memory.limit(0), ["name", "patch"]).collect()] == [3.0] * 151
    with pytest.raises(Exception, match="vector lengths differ"):
        classify.nearest_memory(tokens, spark.createDataFrame([([1.0, 0.0],)], "token array<double>"), ["name", "patch"]).collect()
