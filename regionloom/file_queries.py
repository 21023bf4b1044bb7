"""Queries over files: manifests, caches and reports are written to the shared folder from the standard tables, read back and used."""

from __future__ import annotations

import contextlib
import io
import re
from argparse import Namespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli, shared
from . import queries as Q
from .functions import boxes as B
from .functions import vectors as V
from .operators import classify, episodes, iou, metrics, regions, validate
from .plans import evaluation, reports
from .queries import query, r6, table
from .sources import readers, sinks


def _file(df: DataFrame, path: str) -> str:
    """``df`` as JSON lines in one file of a folder, in the order that it has."""
    df.coalesce(1).write.json(path)
    return path


# -- caches over several files -------------------------------------------------------------------------------------

_PARTS = """
e AS (SELECT vec_id, 'img/' || (vec_id % 90) AS image_path, CASE WHEN vec_id < 20 THEN 2 WHEN vec_id < 300 THEN 0 ELSE 1 END AS part, embedding FROM embeddings),
o AS (SELECT *, row_number() OVER (ORDER BY part, vec_id) - 1 AS row_idx FROM e),
d AS (SELECT image_path, count(*) AS duplicate_count, min(row_idx) AS first_row FROM o GROUP BY ALL),
x AS (SELECT image_path, row_idx, i, embedding[i + 1]::DOUBLE AS x FROM o, range(64) t(i)),"""


def _parts_sql(value: str) -> str:
    return f"""WITH {_PARTS}
v AS (SELECT image_path, i, {value} AS v FROM x GROUP BY ALL)
SELECT (row_number() OVER (ORDER BY first_row) - 1)::BIGINT AS place, image_path, duplicate_count, '64' AS image_width, round(sum(v), 6) + 0.0 AS plain_sum, round(sum(v * (i + 1)), 6) + 0.0 AS place_sum
FROM v JOIN d USING (image_path) GROUP BY image_path, duplicate_count, first_row"""


def _parts(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    """Three files of unequal size, read in an order that is not that of their sizes, deduplicated and read back in order."""
    rows = Q.heatmaps(spark, sf_dir).withColumn("image_path", F.concat(F.lit("img/"), F.col("row_idx") % 90))
    vec, out = F.col("row_idx"), shared.scratch(spark, "parts")
    cut = [(vec >= 20) & (vec < 300), vec >= 300, vec < 20]
    # sizes are given by some rows of a path only, as other programs write them
    payload = [F.col("image_path"), "heatmap", F.when(vec % 7 != 3, 64).alias("image_width"), F.lit(48).alias("image_height"), F.lit("made").alias("producer")]
    files = [_file(rows.where(c).orderBy("row_idx").select(*payload), f"{out}/{name}") for c, name in zip(cut, "bca", strict=True)]
    with contextlib.redirect_stdout(io.StringIO()):  # the command says what it did
        cli.dedupe_heatmaps(spark, Namespace(input=files, output=f"{out}/merged", policy=policy, overwrite=False))
    back = readers.load_heatmaps(spark, f"{out}/merged", extra=True)
    flat = F.flatten("heatmap")
    weighted = V.total(F.transform(flat, lambda x, i: x * (i + 1)))
    return back.where("producer = 'made'").select(F.col("row_idx").alias("place"), "image_path", "duplicate_count", F.lit("64").alias("image_width") if policy != "max" else F.col("image_width"), r6(V.total(flat)).alias("plain_sum"), r6(weighted).alias("place_sum"))


@query(_parts_sql("arg_min(x, row_idx)"))
def heatmap_parts_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "first")


@query(_parts_sql("arg_max(x, row_idx)"))
def heatmap_parts_dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "last")


@query(_parts_sql("max(x)"))
def heatmap_parts_dedupe_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "max")


_LAST = "SELECT 'f' || (vec_id % 70) AS key, arg_max(vec_id, vec_id) AS vec_id FROM embeddings GROUP BY ALL"


@query(f"WITH l AS ({_LAST}), v AS (SELECT key, i, embedding[i + 1]::DOUBLE AS x FROM l JOIN embeddings USING (vec_id), range(64) t(i)) SELECT key, count(*)::INT AS n, round(sum(x * (i + 1)), 6) + 0.0 AS place_sum FROM v GROUP BY ALL")
def feature_cache_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of repeated keys the last line counts."""
    rows = Q.features(spark, sf_dir).orderBy("row_idx").select(F.concat(F.lit("f"), F.col("row_idx") % 70).alias("name"), F.col("feature").alias("values"))
    path = shared.scratch(spark, "features")
    found = readers.load_features(spark, _lines(rows, path), "name", "values")
    return _features_digest(found)


def _lines(rows: DataFrame, path: str) -> str:
    """``rows`` as JSON lines in the order that they have: a .jsonl folder, whose parts the tasks write; packed, as numbers in text take several times their room."""
    sinks.write_jsonl(rows, f"{path}.jsonl", compression="gzip")
    return f"{path}.jsonl"


def _features_digest(found: DataFrame) -> DataFrame:
    weighted = V.total(F.transform("feature", lambda x, i: x * (i + 1)))
    return found.select("key", F.size("feature").alias("n"), r6(weighted).alias("place_sum"))


@query("WITH l AS (SELECT 'f' || (p_partkey % 70) AS key, max(p_partkey) AS p_partkey FROM part GROUP BY ALL) SELECT key, 3 AS n, (p_size + 2 * (p_partkey % 9) + 3 * 0.5)::DOUBLE AS place_sum FROM l JOIN part USING (p_partkey)")
def feature_cache_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as JSON, commas or white space in a CSV; the last row of a key counts."""
    k = F.col("p_partkey")
    number = [F.col("p_size").cast("string"), (k % 9).cast("string"), F.lit("0.5")]
    text = F.when(k % 3 == 0, F.concat(F.lit("["), F.concat_ws(", ", *number), F.lit("]"))).when(k % 3 == 1, F.concat_ws(",", *number)).otherwise(F.concat_ws("  ", *number))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("f"), k % 70).alias("image_path"), text.alias("feature"))
    path = shared.scratch(spark, "features") + ".csv"
    sinks.write_csv(rows, path, ["image_path", "feature"], ["p_partkey"])
    return _features_digest(readers.load_features(spark, path))


@query("WITH " + Q._E + """h AS (SELECT vec_id, i % 32 AS i, sum(CASE WHEN i < 32 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END * x) AS v FROM e GROUP BY ALL)
SELECT (row_number() OVER (ORDER BY 'p' || vec_id) - 1)::BIGINT AS place, 'p' || vec_id AS image_path, count(*)::INT AS n, round(sum(v * (i + 1)), 6) + 0.0 AS place_sum, 'bbox' AS region_region, (vec_id % 5)::BIGINT AS extra FROM h GROUP BY vec_id""")
def feature_fuse_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole and region caches fused; the whole payload stays, fields of any name among it, in path order."""
    f, out = Q.features(spark, sf_dir), shared.scratch(spark, "fuse")
    path = F.concat(F.lit("p"), "row_idx").alias("image_path")
    whole = f.select(path, F.slice("feature", 1, 32).alias("feature"), (F.col("row_idx") % 5).alias("extra"))
    region = f.select(path, F.slice("feature", 33, 32).alias("feature"), F.lit("bbox").alias("region"), F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3)).alias("crop_box"))
    whole.write.json(f"{out}/whole")
    region.write.json(f"{out}/region")
    cli.fuse_features(spark, Namespace(whole_features=f"{out}/whole", region_features=f"{out}/region", output=f"{out}/fused", method="weighted-sum", alpha=0.25, normalize_input=False, normalize_output=False, overwrite=False))
    back = readers._payloads(spark, f"{out}/fused", readers.FEATURES, {"image_path": "missing image_path"}, True)
    weighted = V.total(F.transform("feature", lambda x, i: x * (i + 1)))
    return back.select(F.col("row_idx").alias("place"), "image_path", F.size("feature").alias("n"), r6(weighted).alias("place_sum"), "region_region", "extra")


# -- manifests -----------------------------------------------------------------------------------------------------

_RECORDS = "p_partkey AS row_idx, 'i/' || p_partkey || ', \"x\".png' AS image_path, p_brand AS label, CASE WHEN p_partkey % 3 = 0 THEN 'train' WHEN p_partkey % 3 = 1 THEN 'test' ELSE 'train' END AS split, CASE WHEN p_partkey % 4 = 0 THEN 'm' || p_partkey END AS mask_path, p_size::VARCHAR AS size"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank split stands for train, a blank mask for none."""
    k = F.col("p_partkey")
    split = F.when(k % 3 == 0, "").when(k % 3 == 1, "test").otherwise("train")
    return table(spark, sf_dir, "part").orderBy("p_partkey").select("p_partkey", F.concat(F.lit("i/"), k, F.lit(', "x".png')).alias("image_path"), F.col("p_brand").alias("label"), split.alias("split"), F.when(k % 4 == 0, F.concat(F.lit("m"), k)).otherwise("").alias("mask_path"), F.col("p_size").alias("size"))


def _manifest(records: DataFrame) -> DataFrame:
    return records.select("row_idx", "image_path", "label", "split", "mask_path", F.try_element_at("metadata", F.lit("size")).alias("size"))


@query(f"SELECT {_RECORDS} FROM part")
def manifest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.scratch(spark, "manifest") + ".csv"
    sinks.write_csv(_records(spark, sf_dir), path, ["image_path", "label", "split", "mask_path", "size"], ["p_partkey"])
    return _manifest(readers.load_manifest(spark, path))


@query(f"SELECT * FROM (SELECT {_RECORDS} FROM part) WHERE split = 'train'")
def manifest_jsonl_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank split counts as train once records are normalised."""
    path = _lines(_records(spark, sf_dir).orderBy("p_partkey").drop("p_partkey"), shared.scratch(spark, "manifest"))
    return _manifest(readers.by_split(readers.load_manifest(spark, path), "train", everything=False))


@query("WITH RECURSIVE " + Q._LABELLED + Q._CHOSEN + """
SELECT vec_id AS row_idx, 'img/' || vec_id || '.png' AS image_path, 'keep' AS note, printf('%.2f,%.2f,%.2f,%.2f', bx1, by1, bx2, by2) AS bbox, 'pseudo_heatmap' AS bbox_source, area::VARCHAR AS pseudo_bbox_area, 'native_grid' AS pseudo_bbox_heatmap_processing
FROM bx WHERE p = 0.9::DOUBLE AND a = 0.001::DOUBLE AND k = 'max-score'""")
def pseudo_box_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest CSV and heatmap lines to a manifest with pseudo boxes: the source's columns in their order, then the new ones."""
    maps, out = Q.heatmaps(spark, sf_dir), shared.scratch(spark, "boxes")
    sinks.write_csv(maps.select("row_idx", "image_path", F.lit("keep").alias("note")), f"{out}/m.csv", ["image_path", "note"], ["row_idx"])
    maps.drop("row_idx").write.json(f"{out}/maps")
    cli.pseudo_boxes(spark, Namespace(manifest=f"{out}/m.csv", heatmap_file=f"{out}/maps", output=f"{out}/boxes.csv", split="all", percentile=0.9, min_area_ratio=0.001, component="max-score", upsample_to_image=False, missing_policy="error", duplicate_policy="max", overwrite=False))
    back = readers.read_csv_strict(spark, f"{out}/boxes.csv")
    if back.columns[:3] != ["image_path", "note", "bbox"]:
        raise ValueError(f"columns out of order: {back.columns}")
    return back.select("row_idx", "image_path", "note", "bbox", "bbox_source", "pseudo_bbox_area", "pseudo_bbox_heatmap_processing")


# -- boxes ---------------------------------------------------------------------------------------------------------

_PATHS = """
t AS (SELECT p_partkey AS k, 'a\\' || p_partkey AS image_path, CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE (p_partkey % 20) || ',' || (p_partkey % 10) || ',' || (p_partkey % 20 + 10) || ',' || (p_partkey % 10 + 8) END AS bbox FROM part),
s AS (SELECT p_partkey AS k, p_partkey AS o, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 20 + 2 END AS x FROM part WHERE p_partkey % 5 <> 0
      UNION ALL SELECT p_partkey, p_partkey + 100000000, p_partkey % 20 + 4 FROM part WHERE p_partkey % 7 = 0),
l AS (SELECT k, arg_max(struct_pack(x := x), o).x AS x FROM s GROUP BY k),
j AS (SELECT t.*, l.k IS NOT NULL AS found, l.x FROM t LEFT JOIN l USING (k))"""


@query("WITH " + _PATHS + """
SELECT k AS p_partkey, CASE WHEN NOT found THEN 'missing_pseudo' WHEN k % 11 = 0 THEN 'invalid_gt_bbox' WHEN x IS NULL THEN 'invalid_pseudo_bbox' ELSE 'matched' END AS status,
       CASE WHEN found AND k % 11 <> 0 AND x IS NOT NULL THEN round((10 - (x - k % 20)) * 8.0 / (160 - (10 - (x - k % 20)) * 8.0), 6)::DOUBLE END AS iou FROM j""")
def iou_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth paths have back slashes, pseudo paths either form; the last row of a path counts."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey")
    corner = lambda x: F.concat_ws(",", x, k % 10, x + 10, k % 10 + 8)
    truth = part.select("p_partkey", F.concat(F.lit("a\\"), k).alias("image_path"), F.when(k % 11 == 0, "x").otherwise(corner(k % 20)).alias("bbox"))
    path = F.when(k % 2 == 0, F.concat(F.lit("a/"), k)).otherwise(F.concat(F.lit("a\\"), k)).alias("image_path")
    first = part.where("p_partkey % 5 <> 0").select(k.alias("row_idx"), path, F.when(k % 13 == 0, "").otherwise(corner(k % 20 + 2)).alias("bbox"))
    again = part.where("p_partkey % 7 = 0").select((k + 100_000_000).alias("row_idx"), path, corner(k % 20 + 4).alias("bbox"))
    return iou.compare(truth, first.unionByName(again)).select("p_partkey", "status", r6("iou").alias("iou"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 20)::DOUBLE END AS x1, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 20 + 5.5)::DOUBLE END AS x2 FROM part")
def bbox_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank text is no box; any other that is none would be an error."""
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.when(k % 8 == 0, F.lit(None).cast("string")).otherwise("  ")).otherwise(F.concat_ws(";", k % 20, F.lit("1"), (k % 20 + 5.5).cast("string"), F.lit(" 2 ")))
    return table(spark, sf_dir, "part").select("p_partkey", B.parse_box_strict(text).alias("b")).select("p_partkey", "b.x1", "b.x2")


@query("SELECT p_partkey, 1 + (p_partkey % 3 <> 0)::INT AS n_labels, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 9)::DOUBLE END AS x1, CASE WHEN p_partkey % 5 <> 0 THEN 1.5::DOUBLE END AS y1, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 9 + 40)::DOUBLE END AS x2, CASE WHEN p_partkey % 5 <> 0 THEN 30::DOUBLE END AS y2 FROM part")
def shape_labels_and_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with several shapes; nodes of a wrong type are passed over."""
    k = F.col("p_partkey")
    points = F.when(k % 5 == 0, '"none"').otherwise(F.concat(F.lit("[["), k % 9, F.lit(", 1.5], [\"x\", 3], [7], ["), k % 9 + 40, F.lit(", 30]]")))
    text = F.concat(F.lit('[{"label": "hole", "points": '), points, F.lit('}, 5, {"label": "", "points": [[20, 20]]}, {"label": '), F.when(k % 3 == 0, "null").otherwise('"crack"'), F.lit("}]"))
    text = F.when(k % 5 == 0, F.replace(text, F.lit("[[20, 20]]"), F.lit("[]"))).otherwise(text)
    shapes = F.try_variant_get(F.parse_json(text), "$", "array<variant>")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(readers.shape_labels(shapes)).alias("n_labels"), readers.shape_box(shapes).alias("b")).select("p_partkey", "n_labels", "b.*")


# -- heatmaps ------------------------------------------------------------------------------------------------------

_UP = """
c0 AS (SELECT vec_id, embedding AS e FROM embeddings),
ax AS (SELECT t, greatest(0, least(7, floor((t + 0.5) * 8 / 16.0 - 0.5)))::INT AS a, (t + 0.5) * 8 / 16.0::DOUBLE - 0.5 AS s FROM range(16) r(t)),
ay AS (SELECT t, greatest(0, least(7, floor((t + 0.5) * 8 / 12.0 - 0.5)))::INT AS a, (t + 0.5) * 8 / 12.0::DOUBLE - 0.5 AS s FROM range(12) r(t)),
wx AS (SELECT t, a, least(7, a + 1) AS b, CASE WHEN s < 0 THEN 0 ELSE s - a END::DOUBLE AS w FROM ax), wy AS (SELECT t, a, least(7, a + 1) AS b, CASE WHEN s < 0 THEN 0 ELSE s - a END::DOUBLE AS w FROM ay),
c AS (SELECT vec_id, wy.t AS y, wx.t AS x, (e[wy.a * 8 + wx.a + 1]::DOUBLE * (1 - wx.w) + e[wy.a * 8 + wx.b + 1]::DOUBLE * wx.w) * (1 - wy.w) + (e[wy.b * 8 + wx.a + 1]::DOUBLE * (1 - wx.w) + e[wy.b * 8 + wx.b + 1]::DOUBLE * wx.w) * wy.w AS v FROM c0, wx, wy),
s AS (SELECT vec_id, list_sort(list(v))[1 + ceil(0.9::DOUBLE * 191)::INT] AS t FROM c GROUP BY vec_id),
hot AS (SELECT c.vec_id, y, x, v, y * 16 + x AS pos FROM c JOIN s USING (vec_id) WHERE v >= t),
reach AS (SELECT vec_id, y, x, pos AS root FROM hot UNION SELECT h.vec_id, h.y, h.x, r.root FROM reach r JOIN hot h ON h.vec_id = r.vec_id AND abs(h.y - r.y) + abs(h.x - r.x) = 1),
lab AS (SELECT vec_id, y, x, min(root) AS root FROM reach GROUP BY ALL),
comp AS (SELECT l.vec_id, root, count(*)::INT AS area, min(x)::INT AS x1, min(y)::INT AS y1, max(x)::INT AS x2, max(y)::INT AS y2 FROM lab l GROUP BY ALL)"""


@query("WITH RECURSIVE " + _UP + "SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY root) - 1)::INT AS comp, area, x1, y1, x2, y2 FROM comp")
def heatmap_components_upsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholded and labelled on the image's 16 x 12 pixels."""
    maps = Q.heatmaps(spark, sf_dir).withColumn("image_width", F.lit(16)).withColumn("image_height", F.lit(12))
    t = regions.component_table(maps, [0.9], ["row_idx"], upsample=True).where("not is_peak")
    return t.select(F.col("row_idx").alias("vec_id"), "comp", "area", *[F.col(f"c{k}").alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("""
WITH g AS (SELECT event_id AS row_idx, 'i' || (user_id % 40) AS image_path, 1 + event_id % 2 AS w, 1 + (event_id % 3 = 0)::INT AS h, CASE WHEN event_id % 7 = 0 THEN 8 ELSE 9 END AS iw FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY row_idx) AS n, first_value(struct_pack(w := w, h := h, iw := iw)) OVER (PARTITION BY image_path ORDER BY row_idx) AS s FROM g),
c AS (SELECT *, CASE WHEN n = 1 THEN 'ok' WHEN w <> s.w OR h <> s.h THEN 'duplicate_heatmap_size' WHEN iw <> s.iw THEN 'duplicate_image_width' ELSE 'ok' END AS e FROM f)
SELECT image_path, e AS error, count(*) AS n, min(row_idx) AS first_row FROM c GROUP BY ALL""")
def heatmap_validate_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes that differ from those of the path's first row."""
    k = F.col("event_id")
    grid = F.array_repeat(F.array_repeat(F.lit(1.5), (1 + k % 2).cast("int")), F.when(k % 3 == 0, 2).otherwise(1))
    line = F.to_json(F.struct(F.concat(F.lit("i"), F.col("user_id") % 40).alias("image_path"), grid.alias("heatmap"), F.when(k % 7 == 0, 8).otherwise(9).alias("image_width"), F.lit(9).alias("image_height")))
    lines = shared.spread(table(spark, sf_dir, "events").select("event_id", "user_id")).select(k.alias("row_idx"), line.alias("value"))
    checked = validate.with_duplicates(validate.report(lines), "allow")
    return checked.groupBy("image_path", F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"), F.min("row_idx").alias("first_row"))


# -- classification ------------------------------------------------------------------------------------------------


@query("WITH b AS (" + Q._PRED + "), a AS (SELECT 'pooled' AS grain, y_true, y_pred FROM b UNION ALL SELECT episode::VARCHAR, y_true, y_pred FROM b)," + Q._metrics_sql("a", "grain,") + f"SELECT grain, n, {Q._SC} FROM sc")
def pooled_vs_episode_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures over all queries together, beside those of each episode: both from one confusion table."""
    cells = shared.written(metrics.confusion(Q._predictions(spark, sf_dir), ["episode"]), "cells")
    each = metrics.scores(cells, ["episode"]).withColumn("grain", F.col("episode").cast("string")).drop("episode")
    pooled = metrics.scores(cells.groupBy("y_true", "y_pred").agg(F.sum("count").alias("count"))).withColumn("grain", F.lit("pooled"))
    return Q._rounded(each.unionByName(pooled), *Q._MEASURES)


@query("WITH a AS (" + Q._PRED + """), b AS (SELECT y_true, y_pred, 'r' AS m FROM a UNION ALL SELECT y_true, y_base, 'b' FROM a),""" + Q._metrics_sql("b", "m,") + """
, r AS (SELECT * FROM f WHERE m = 'r'), o AS (SELECT * FROM f WHERE m = 'b')
SELECT label, (row_number() OVER (ORDER BY round(coalesce(r.recall, 0) - coalesce(o.recall, 0), 9) DESC, round(coalesce(r.f1, 0) - coalesce(o.f1, 0), 9) DESC, coalesce(r.true_count, 0) DESC, label))::INT AS rank FROM r FULL JOIN o USING (label)""")
def per_class_delta_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Q._predictions(spark, sf_dir)
    sides = [metrics.per_class(metrics.confusion(p.select("y_true", F.col(c).alias("y_pred")))) for c in ("y_pred", "y_base")]
    both = metrics.compare_per_class(*sides).withColumns({c: F.round(c, 9) for c in ("recall_delta", "f1_delta")})
    rows = both.orderBy(*metrics.delta_order()).select("label").collect()  # a row for each class
    return spark.createDataFrame([(r.label, i) for i, r in enumerate(rows, 1)], "label string, rank int")


@query("WITH " + Q._TWO + Q._FUSED.format(weights="(0, 0.75::DOUBLE)") + "SELECT vec_id, y_pred, round(score, 6) + 0.0 AS score FROM b")
def score_weights_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of any sum: 6 and 2 are three quarters and one."""
    whole, region = Q._branches(spark, sf_dir)
    best = classify.argmax(classify.fuse_scores(whole, region, ["row_idx", "y_true"], 6, 2), ["row_idx", "y_true"], [F.col("class").asc()], digits=9)
    return best.select(F.col("row_idx").alias("vec_id"), "y_pred", r6("score").alias("score"))


@query("SELECT p_partkey, 3 AS n, (p_size + 2 * 1.5 + 3 * (p_partkey % 4))::DOUBLE AS place_sum FROM part")
def vector_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's feature column: numbers parted by white space of any kind."""
    text = F.concat(F.lit(" "), F.col("p_size"), F.lit("\t1.5 \n "), F.col("p_partkey") % 4, F.lit("  "))
    rows = table(spark, sf_dir, "part").select("p_partkey", V.parse_spaced(text).alias("v"))
    return rows.select("p_partkey", F.size("v").alias("n"), V.total(F.transform("v", lambda x, i: x * (i + 1))).alias("place_sum"))


@query("WITH t AS (SELECT vec_id AS row_idx, label::VARCHAR AS label, CASE WHEN vec_id % 3 = 0 THEN 'train' ELSE 'test' END AS split FROM embeddings) SELECT row_idx, label FROM t WHERE split = 'train' AND label IN ('1', '2', '3') QUALIFY row_number() OVER (ORDER BY sha256('42:' || row_idx), row_idx) <= 25")
def memory_rows_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a split whose label, defect or object is among some, cut to the bank's size."""
    f = Q.features(spark, sf_dir)
    records = f.select("row_idx", "label", F.concat(F.lit("i"), "row_idx").alias("image_path"), F.when(F.col("row_idx") % 3 == 0, "train").otherwise("test").alias("split"), F.lit(None).cast("string").alias("defect_name"), F.lit("").alias("object_name"))
    return episodes.select_memory_hashed(records, "train", episodes.parse_label_set(" 1, 2,3"), 25).select("row_idx", "label")


_EPISODES = Q._HASHED.replace("(VALUES (0, 5, 1), (1, 5, 3)) s(i, n_way, k_shot), range(20) t(e)", "(VALUES (0, 5, 1), (1, 5, 3), (2, 5, 5), (3, 10, 1), (4, 10, 5)) s(i, n_way, k_shot), range(40) t(e)")


@query("WITH " + _EPISODES + "," + Q._E + """
m AS (SELECT setting_idx, episode_idx, d.label AS class, i, avg(x) AS x FROM d JOIN e ON e.vec_id = d.row_idx WHERE role = 'support' GROUP BY ALL),
p AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY setting_idx, episode_idx, class)) AS u FROM m),
u AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM e),
s AS (SELECT d.setting_idx, d.episode_idx, d.row_idx, d.label AS y_true, p.class, sum(p.u * u.x) AS score FROM d JOIN p USING (setting_idx, episode_idx) JOIN u ON u.vec_id = d.row_idx AND u.i = p.i WHERE role = 'query' GROUP BY ALL),
b AS (SELECT *, class AS y_pred FROM s QUALIFY row_number() OVER (PARTITION BY setting_idx, episode_idx, row_idx ORDER BY round(score, 9) DESC, class) = 1),
""" + Q._metrics_sql("b", "setting_idx, episode_idx,") + "SELECT setting_idx, count(*) AS episodes, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(coalesce(stddev_samp({m}), 0), 6) AS {m}_stdev" for m in Q._MEASURES) + " FROM sc GROUP BY ALL")
def few_shot_grid_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid's settings over 40 episodes each, drawn by hash."""
    f, keys = Q.features(spark, sf_dir), evaluation.EPISODE
    drawn = episodes.sample_hashed(f.select("row_idx", "label"), episodes.parse_grid(evaluation.GRID), 40, 5).withColumn("pos", F.col("row_idx"))
    best = classify.argmax(classify.episode_scores(drawn, f, keys), [*keys, "pos", "y_true"], [F.col("class").asc()], digits=9)
    each = shared.written(evaluation.episode_metrics(best, keys), "episode-metrics")
    out = metrics.mean_stdev(each, ["setting_idx"], list(Q._MEASURES)).join(each.groupBy("setting_idx").agg(F.count("*").alias("episodes")), "setting_idx")
    return Q._rounded(out, *[f"{m}_{k}" for m in Q._MEASURES for k in ("mean", "stdev")])


# -- reports -------------------------------------------------------------------------------------------------------


@query("""
WITH n AS (SELECT n_nationkey AS k, n_name FROM nation),
s AS (SELECT 0 AS i, '5-way 1-shot' AS setting UNION ALL SELECT 1, '5-way 3-shot')
SELECT k AS row_idx, 'm|' || k AS model, CASE WHEN k % 3 = 0 THEN 'ok' WHEN k % 3 = 1 THEN 'failed' ELSE 'skipped' END AS status, coalesce(setting, '-') AS setting,
       CASE WHEN setting IS NULL THEN '-' ELSE (50 + k) || '.00 ± 1.00' END AS accuracy, CASE WHEN k % 3 = 1 THEN 'no | luck' ELSE '' END AS message FROM n LEFT JOIN s ON k % 3 = 0""".replace("'m|' ||", "'m\\|' ||").replace("no | luck", "no \\| luck"))
def model_summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status lines and the tables of their reports, one row for each model and setting; bars in cells are escaped."""
    out = shared.scratch(spark, "models")
    rows = [r.n_nationkey for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 nations
    files, lines = [], []
    for k in rows:
        md = re.sub("^file:/+", "/", f"{out}/{k}.md") if k % 3 == 0 else ""
        if md:
            results = [{"n_way": 5, "k_shot": s, "episodes": 9, **{f"{m}_{p}": v for m in evaluation.MEASURES for p, v in (("mean", (50 + k) / 100), ("stdev", 0.01))}} for s in (1, 3)]
            sinks.write_text(reports.grid_markdown("Results", {}, results), md)
            files.append(md)
        status = "ok" if k % 3 == 0 else "failed" if k % 3 == 1 else "skipped"
        lines.append(f'{{"model": "m|{k}", "status": "{status}", "result_md": "{md}", "message": "{"no | luck" if k % 3 == 1 else ""}"}}')
    sinks.write_text("\n\n".join(lines) + "\n", f"{out}/status.jsonl")
    found = reports.model_summary(readers.read_status(spark, f"{out}/status.jsonl"), readers.read_results_md(spark, files))
    return found.select((F.col("row_idx") / 2).cast("int").alias("row_idx"), "model", "status", "setting", "accuracy", "message")


@query("SELECT k, CASE WHEN (k % 4) = 0 THEN 'NA' WHEN (k % 4) = 1 THEN k::VARCHAR ELSE printf('%.4f', k / 7) END AS cell FROM (SELECT n_nationkey AS k FROM nation)")
def report_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [r.n_nationkey for r in table(spark, sf_dir, "nation").collect()]
    return spark.createDataFrame([(k, reports.number(None if k % 4 == 0 else k if k % 4 == 1 else k / 7)) for k in rows], "k int, cell string")

