"""Readers for manifests, feature caches, heatmap caches, annotations and run summaries.

A DataFrame has no order, but several operators depend on file order; readers
attach ``row_idx`` where it matters.  Errors in the data are raised by the plan
(``raise_error``) when rows are read, or by an explicit ``require`` action.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from ..functions import paths as P
from ..functions import vectors as V

#: Columns of the canonical manifest, in order (fixed values).
MANIFEST_COLUMNS = ["image_path", "label", "split", "mask_path", "object_name", "defect_name", "annotation_path", "bbox", "polygon_count"]
HEATMAP = "image_path string, heatmap array<array<double>>, image_width string, image_height string, heatmap_width string, heatmap_height string, label string, split string, object_name string, defect_name string, localizer string, model string, score_normalization string, image_size string"
FEATURES = "image_path string, label string, split string, object_name string, defect_name string, region string, crop_box array<int>, feature array<double>"


def _plain(path: Column) -> Column:
    """A file's path as it is written: without escapes, local ones without scheme."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def _asked(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths asked for as ``_plain`` gives those of their files."""
    out = []
    for p in paths:
        store, there = shared.hadoop(spark, p)
        out.append(re.sub("^file:/+", "/", store.makeQualified(there).toString()))
    return out


#: A part's number: names sort wrongly once it has six digits.
_PART = r"part-(\d+)[^/]*$"
#: Files and blocks whose offsets may be broadcast (about 100 bytes each).
_MOST_SPLITS = 500_000


def in_file_order(read: DataFrame, paths: str | list[str], name: str = "row_idx") -> DataFrame:
    """Rows of a file scan with consecutive numbers: files in the order asked for (by name within a folder or pattern), blocks and lines in theirs.

    Rows stay where they are.  A block's rows are counted first; the table of blocks gives each its offset.
    """
    spark = read.sparkSession
    asked = _asked(spark, [paths] if isinstance(paths, str) else list(paths))
    raw = read.select("*", _plain(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_id"))
    blocks = raw.groupBy("_file", "_from").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    places = F.map_from_arrays(F.array(*[F.lit(p) for p in dict.fromkeys(asked)]), F.array(*[F.lit(asked.index(p)) for p in dict.fromkeys(asked)]))
    folder = F.regexp_extract("_file", "^(.*)/[^/]*$", 1)
    place = F.coalesce(F.try_element_at(places, F.col("_file")), F.try_element_at(places, folder), F.lit(len(asked)))
    order = Window.orderBy(place, folder, F.regexp_extract("_file", _PART, 1).try_cast("long").asc_nulls_first(), "_file", "_from")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("_file", "_from", "_first", before.alias("_before"))
    files = len(read._jdf.inputFiles())
    size = int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if files + (size >> 22) <= _MOST_SPLITS:
        blocks = F.broadcast(blocks)
    return raw.join(blocks, ["_file", "_from"]).withColumn(name, F.col("_id") - F.col("_first") + F.col("_before")).drop("_from", "_id", "_first", "_before", "_file")


def in_order(df: DataFrame, *order, name: str = "row_idx") -> DataFrame:
    """``df`` with consecutive numbers in ``order``: sorted into a written table once, so that a task run again sees the same ranges."""
    sorted_rows, path = shared.written_at(df.orderBy(*order), "ordered")
    rows = sorted_rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    # a row for each part of the sort
    parts = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    upto = Window.orderBy(F.regexp_extract("_file", _PART, 1).cast("long")).rowsBetween(Window.unboundedPreceding, -1)
    parts = F.broadcast(parts.select("_file", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before")))
    return rows.join(parts, "_file").withColumn(name, F.col("_at") + F.col("_before")).drop("_file", "_at", "_before")


def require(df: DataFrame, message: str) -> DataFrame:
    """``df``, or an error if it is empty."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def _suffix(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def read_csv(spark: SparkSession, path: str, row_index: bool = True) -> DataFrame:
    """A CSV with a header, all columns text, columns in file order; no checks."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\u0000").csv(path)
    return (in_file_order(df, path) if row_index else df).fillna("")


def read_csv_strict(spark: SparkSession, path: str) -> DataFrame:
    """The same; without header, rows or a path in a row it is an error."""
    df = read_csv(spark, path)
    if "image_path" not in df.columns:
        raise ValueError(f"{path} has no image_path column")
    require(df, f"{path} has no rows")
    if not df.where(P.strip(F.col("image_path")) == "").isEmpty():
        raise ValueError(f"{path} has rows without image_path")
    return df


def _metadata(df: DataFrame, known: list[str]) -> Column:
    rest = [c for c in df.columns if c not in (*known, "row_idx")]
    return F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]) if rest else F.create_map().cast("map<string,string>")


def normalize_records(df: DataFrame) -> DataFrame:
    """Manifest rows: blank split is train, blank optional text is null, other columns go to ``metadata``."""
    for c in ("image_path", "label"):
        if c not in df.columns:
            raise ValueError(f"a manifest needs the column {c}")
    known = ["image_path", "label", "split", "mask_path", "object_name", "defect_name"]
    text = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    optional = lambda c: F.nullif(text(c), F.lit(""))
    split = F.coalesce(optional("split"), F.lit("train"))
    kept = ["row_idx"] if "row_idx" in df.columns else []
    return df.select(*kept, text("image_path").alias("image_path"), text("label").alias("label"), split.alias("split"), *[optional(c).alias(c) for c in known[3:]], _metadata(df, known).alias("metadata"))


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, row_idx, file, line) of text files, blank lines included; ``line`` counts from 1 in its file."""
    read = spark.read.text(paths)
    rows = in_file_order(read.select("value", _plain(F.col("_metadata.file_path")).alias("file"), "_metadata"), paths)
    firsts = rows.groupBy("file").agg(F.min("row_idx").alias("_first"))
    if len(read._jdf.inputFiles()) <= _MOST_SPLITS:
        firsts = F.broadcast(firsts)
    return rows.join(firsts, "file").select("value", "row_idx", "file", (F.col("row_idx") - F.col("_first") + 1).alias("line"))


def _fault(message: str) -> Column:
    return F.raise_error(F.concat(F.lit(message + " at "), "file", F.lit(":"), F.col("line").cast("string")))


def _json_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(row_idx, file, line, value, json) of the lines that are not blank; text that is no JSON is an error naming file and line."""
    lines = numbered_lines(spark, paths).where(P.strip(F.col("value")) != "")
    return lines.withColumn("json", F.coalesce(F.try_parse_json("value"), _fault("invalid JSON").cast("variant")))


def _payloads(spark: SparkSession, paths: str | list[str], known: str, needed: dict[str, str], extra: bool) -> DataFrame:
    """(row_idx, fields) of JSON lines: the ``known`` fields with their types, and with ``extra`` all others as they are found.

    Every line counts: one that is no JSON object, or lacks a ``needed`` field, is an error naming file and line.
    """
    schema = T.StructType.fromDDL(known)
    if extra:
        names = {f.name for f in schema.fields}
        seen = spark.read.json(paths).schema.fields
        schema = T.StructType([*schema.fields, *[f for f in seen if f.name not in names and f.name != "_corrupt_record" and f.name != "row_idx"]])
    lines = numbered_lines(spark, paths).where(P.strip(F.col("value")) != "")
    parsed = F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("row_idx", "file", "line", "value", parsed.alias("p"))
    # a field of another type than the known one is a bad record as a whole: told apart from what is no JSON
    fault = F.when(F.col("p._bad").isNotNull() | F.col("p").isNull(), F.when(F.try_parse_json("value").isNull(), _fault("invalid JSON")).otherwise(_fault("a field of a wrong type, or no object")))
    for field, message in needed.items():
        blank = F.col(f"p.{field}").isNull() if schema[field].dataType != T.StringType() else P.strip(F.coalesce(F.col(f"p.{field}"), F.lit(""))) == ""
        fault = fault.when(blank, _fault(message))
    first = next(iter(needed))
    # whoever reads a row reads its key, and so meets its fault
    return rows.select("row_idx", *[(F.coalesce(fault.cast("string"), F.col(f"p.{f.name}")) if f.name == first else F.col(f"p.{f.name}")).alias(f.name) for f in schema.fields])


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest from .csv, .jsonl or .ndjson, normalised."""
    kind = _suffix(path)
    if kind == ".csv":
        return normalize_records(read_csv(spark, path))
    if kind not in (".jsonl", ".ndjson"):
        raise ValueError(f"a manifest is .csv, .jsonl or .ndjson: {path}")
    rows = _json_rows(spark, path).select("row_idx", "file", "line", F.from_json(F.when(F.col("json").isNotNull(), F.col("value")), "map<string,string>").alias("m"))
    get = lambda c: F.try_element_at("m", F.lit(c))
    missing = _fault("a manifest row needs image_path and label")
    named = ["image_path", "label", "split", "mask_path", "object_name", "defect_name"]
    optional = lambda c: F.nullif(get(c), F.lit(""))
    return rows.select(
        "row_idx", F.coalesce(get("image_path"), missing).alias("image_path"), F.coalesce(get("label"), missing).alias("label"),
        F.coalesce(optional("split"), F.lit("train")).alias("split"), *[optional(c).alias(c) for c in named[3:]],
        F.map_filter("m", lambda k, v: ~k.isin(named)).alias("metadata"),
    )


def by_split(df: DataFrame, split: str, everything: bool = True) -> DataFrame:
    """Rows of a split; with ``everything`` the name 'all' takes every row."""
    return df if everything and split == "all" else df.where(F.col("split") == split)


def load_features(spark: SparkSession, path: str, key: str = "image_path", feature: str = "feature") -> DataFrame:
    """(key, feature) of a feature cache, .csv or JSON lines; of repeated keys the last counts; an empty vector is an error."""
    kind = _suffix(path)
    if kind == ".csv":
        rows = read_csv(spark, path).select("row_idx", F.col(key).alias("key"), V.parse_vector(F.col(feature)).alias("feature"))
    elif kind in (".jsonl", ".ndjson"):
        m = _json_rows(spark, path)
        value = F.try_variant_get("json", f"$.{feature}", "array<double>")
        text = F.try_variant_get("json", f"$.{feature}", "string")
        rows = m.select("row_idx", F.try_variant_get("json", f"$.{key}", "string").alias("key"), F.coalesce(value, V.parse_vector(text)).alias("feature"))
    else:
        raise ValueError(f"a feature cache is .csv, .jsonl or .ndjson: {path}")
    good = F.when(F.size("feature") > 0, F.col("feature")).otherwise(F.raise_error(F.concat(F.lit("empty feature: "), "key")).cast("array<double>"))
    return rows.groupBy("key").agg(F.max_by("feature", "row_idx").alias("feature")).withColumn("feature", good)


def load_fusion_cache(spark: SparkSession, path: str) -> DataFrame:
    """Whole payloads of a feature cache, fields of any name; a repeated path or an empty file is an error."""
    df = require(_payloads(spark, path, FEATURES, {"image_path": "missing image_path", "feature": "missing feature"}, True), f"empty feature cache: {path}").drop("row_idx")
    if twice := df.groupBy("image_path").count().where("count > 1").orderBy("image_path").limit(5).collect():
        raise ValueError(f"repeated image_path in {path}: {', '.join(r.image_path for r in twice)}")
    return df


def load_heatmaps(spark: SparkSession, paths: str | list[str], extra: bool = False) -> DataFrame:
    """Heatmap rows in file order, one file after another; no rows, or a row without path or heatmap, is an error."""
    return require(_payloads(spark, paths, HEATMAP, {"image_path": "missing image_path", "heatmap": "missing heatmap"}, extra), f"no heatmaps in {paths}")


def _matching(folder: str, pattern: str) -> list[str]:
    """Files of a folder in the order of their names, on whatever store it is."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    store, there = shared.hadoop(spark, f"{folder.rstrip('/')}/{pattern}")
    return sorted(re.sub("^file:/+", "/", f.getPath().toString()) for f in store.globStatus(there) or [] if f.isFile())


def heatmap_parts(files: list[str] | None = None, folder: str | None = None, pattern: str = "*.jsonl", file: str | None = None) -> list[str]:
    """Which files to read: a list before a folder with a pattern before one file; none is an error."""
    found = list(files or []) or (_matching(folder, pattern) if folder else []) or ([file] if file else [])
    if not found:
        raise ValueError("no heatmap files")
    return found


def crawl_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative) of the images below ``root``; only names are listed, no content is read."""
    return _crawl(spark, root).where(P.is_image(F.col("path")))


def _crawl(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    prefix = os.path.abspath(root).rstrip("/") + "/"
    return files.withColumn("relative", F.expr(f"substring(path, {len(prefix) + 1})"))


def find_annotations(images: DataFrame, jsons: DataFrame) -> DataFrame:
    """(path, relative, annotation): same stem, then the first matching folder swap, then the first of that name below the image's folder."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", ".json")
    swap = lambda a, b: F.when(F.concat(F.lit("/"), F.col("relative")).rlike(f"/{a}/"), stem(F.regexp_replace(F.concat(F.lit("/"), F.col("relative")), f"^(.*?)/{a}/", f"$1/{b}/")))
    candidates = F.array(
        F.struct(F.lit(1).alias("prio"), stem(F.concat(F.lit("/"), F.col("relative"))).alias("want")),
        *[F.struct(F.lit(i).alias("prio"), swap(a, b).alias("want")) for i, (a, b) in enumerate((("images", "annotations"), ("image", "annotation"), ("imgs", "labels")), 2)],
    )
    rows = jsons.select(F.col("relative").alias("json"))
    exact = images.select("path", "relative", F.explode(candidates).alias("c")).join(rows, F.expr("c.want = concat('/', json)")).select("path", "c.prio", "json")
    # the last resort is an equi-join on the file name, then a test of the folder
    name = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    folder = F.regexp_extract("relative", "^(.*/)?", 0)
    near = images.withColumn("name", name(stem(F.col("relative")))).withColumn("folder", folder).join(rows.withColumn("name", name(F.col("json"))), "name").where(F.col("json").startswith(F.col("folder"))).select("path", F.lit(9).alias("prio"), "json")
    best = exact.unionByName(near).groupBy("path").agg(F.min_by("json", F.struct("prio", "json")).alias("annotation"))
    return images.join(best, "path", "left")


def read_annotations(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    """(annotation, labels, box_text numbers, polygon_count) of LabelMe files; nodes of another type are passed over."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root)
    prefix = os.path.abspath(root).rstrip("/") + "/"
    text = text.select(F.substring(_plain(F.col("_metadata.file_path")), len(prefix) + 1, 1 << 30).alias("annotation"), "value")
    wanted = text.join(found.select("annotation").where("annotation is not null").distinct(), "annotation", "left_semi")
    shapes = F.coalesce(F.try_variant_get(F.parse_json("value"), "$.shapes", "array<variant>"), F.array().cast("array<variant>"))
    return wanted.select("annotation", shapes.alias("shapes")).select("annotation", F.size("shapes").alias("polygon_count"), shape_labels(F.col("shapes")).alias("labels"), shape_box(F.col("shapes")).alias("box"))


def shape_labels(shapes: Column) -> Column:
    labels = F.transform(shapes, lambda s: F.try_variant_get(s, "$.label", "string"))
    return F.filter(labels, lambda x: x.isNotNull() & (x != ""))


def shape_box(shapes: Column) -> Column:
    """Least box around the points of all shapes; null without points."""
    points = F.flatten(F.transform(shapes, lambda s: F.coalesce(F.try_variant_get(s, "$.points", "array<variant>"), F.array().cast("array<variant>"))))
    pairs = F.filter(F.transform(points, lambda p: F.try_variant_get(p, "$", "array<double>")), lambda p: F.size(p) >= 2)
    at = lambda k: F.transform(pairs, lambda p: F.get(p, F.lit(k)))
    return F.when(F.size(pairs) > 0, F.struct(F.array_min(at(0)).alias("x1"), F.array_min(at(1)).alias("y1"), F.array_max(at(0)).alias("x2"), F.array_max(at(1)).alias("y2")))


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """(model, status, result_md, message) of a run's summary lines."""
    return _payloads(spark, path, "model string, status string, result_md string, message string", {"model": "missing model"}, False)


#: A results table's row: setting, episodes and three measures.
_RESULT = r"^\|\s*([^|]+?)\s*\|\s*(\d+)\s*\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*$"


def read_results_md(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, setting, episodes, accuracy, balanced, macro_f1) of the tables in Markdown reports."""
    lines = spark.read.text(paths).select(_plain(F.col("_metadata.file_path")).alias("file"), "value").where(F.col("value").rlike(_RESULT))
    part = lambda k: F.regexp_extract("value", _RESULT, k)
    return lines.select("file", part(1).alias("setting"), part(2).cast("int").alias("episodes"), part(3).alias("accuracy"), part(4).alias("balanced"), part(5).alias("macro_f1")).where("setting <> 'Setting'")
