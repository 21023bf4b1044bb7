"""Contracts for models that make features or heatmaps from images.

Decoding and networks are plug-ins: a plug-in is a function over a pandas batch,
so that any library can be used where it is installed.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import grids as G
from ..functions import images as I
from ..functions import vectors as V
from . import classify

#: A batch of records to vectors.
Extractor = Callable[[pd.DataFrame], list[list[float]]]
#: A batch of records to heatmaps.
Localizer = Callable[[pd.DataFrame], list[list[list[float]]]]


def extract_features(records: DataFrame, extractor: Extractor, dim: int | None = None) -> DataFrame:
    """``records`` with ``feature``; a vector of another dimension is an error."""
    return _mapped(records, extractor, "feature array<double>", "feature", lambda v: dim is None or len(v) == dim)


def localize(records: DataFrame, localizer: Localizer) -> DataFrame:
    """``records`` with ``heatmap``."""
    return _mapped(records, localizer, "heatmap array<array<double>>", "heatmap", lambda h: bool(len(h)))


def _mapped(records: DataFrame, function, ddl: str, name: str, good) -> DataFrame:
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = function(pdf)
            if len(values) != len(pdf) or not all(map(good, values)):
                raise ValueError(f"the plug-in gave a wrong {name}")
            yield pdf.assign(**{name: values})

    before = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields)
    return records.mapInPandas(made, f"{before}, {ddl}")


def open_images(spark, records: DataFrame, root: str) -> DataFrame:
    """``records`` with ``content`` of their image files, found absolute or below ``root``; a missing file is an error."""
    path = F.when(F.col("image_path").startswith("/"), F.col("image_path")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "image_path"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("_file"), "content")
    both = records.withColumn("_path", path).join(files, F.col("_path") == F.col("_file"), "left")
    missing = F.raise_error(F.concat(F.lit("no image: "), "_path")).cast("binary")
    return both.withColumn("content", F.coalesce("content", missing)).drop("_path", "_file")


def mask_crop(mask: Column, padding: float = 0.15, least: int = 32) -> Column:
    """Crop around the true cells of a mask; the whole image if there are none."""
    tight = F.when(G.mask_area(mask) > 0, G.tight_box(mask))
    return B.padded_crop(tight, G.width(mask), G.height(mask), padding, least)


def apply_crop(pixels: np.ndarray, mask: np.ndarray, crop: tuple[int, int, int, int], background: str = "black") -> np.ndarray:
    """The crop of an image array, outside the mask black or kept."""
    left, top, right, bottom = crop
    part = pixels[top:bottom, left:right]
    return part if background == "keep" else I.masked(part, mask[top:bottom, left:right])


def of_regions(model: Callable[[list[np.ndarray]], list[list[float]]], decode: Callable[[bytes], np.ndarray] = I.read_png, region: str = "whole", padding: float = 0.15, least: int = 32, background: str = "black") -> Extractor:
    """An extractor that decodes ``content`` and gives ``model`` the whole images, or their crops by ``bbox`` or ``mask_content``.

    A ``bbox`` is four numbers in a text; a blank or degenerate one means the whole image.
    """
    if region not in ("whole", "bbox", "mask"):
        raise ValueError(f"no region {region}")

    def box_of(text) -> tuple | None:
        try:
            box = tuple(float(p) for p in str(text or "").replace(";", ",").split(",") if p.strip())
        except ValueError:
            return None
        return box if len(box) == 4 and box[2] > box[0] and box[3] > box[1] else None

    def cut(row) -> np.ndarray:
        pixels = decode(row["content"])
        size = pixels.shape[1], pixels.shape[0]
        if region == "whole":
            return pixels
        if region == "bbox":
            left, top, right, bottom = I.crop_of(box_of(row["bbox"]), *size, padding, least)
            return pixels[top:bottom, left:right]
        mask = I.load_mask(row["mask_content"], size, row.get("mask_path") or "")
        # the box goes through its text form of two decimals, which whole numbers survive
        return apply_crop(pixels, mask, I.crop_of(I.mask_box(mask), *size, padding, least), background)

    return lambda pdf: model([cut(row) for row in pdf.to_dict("records")])


def require_modules(*names: str) -> None:
    """Stops before any job if a plug-in's libraries are not installed."""
    missing = [n for n in names if importlib.util.find_spec(n) is None]
    if missing:
        raise SystemExit(f"missing libraries for extraction: {', '.join(missing)}")


def device_of(asked: str = "auto", has_cuda: Callable[[], bool] = lambda: False) -> str:
    """The device that is asked for; ``auto`` is cuda where the plug-in's library has it."""
    return asked if asked != "auto" else "cuda" if has_cuda() else "cpu"


def heatmaps_from_tokens(tokens: DataFrame, keys: list[str], column: str = "tokens") -> DataFrame:
    """(keys, heatmap): patch contrast of normalised tokens as a normalised square grid."""
    rows = tokens.select(*keys, F.transform(column, V.l2_normalize).alias("_t"))
    return rows.select(*keys, V.scores_to_grid(V.patch_contrast(F.col("_t"))).alias("heatmap"))


def extract_tokens(records: DataFrame, extractor) -> DataFrame:
    """``records`` with ``tokens``, the patch vectors of each image."""
    return _mapped(records.drop("metadata"), extractor, "tokens array<array<double>>", "tokens", lambda t: bool(len(t)))


def heatmaps_from_memory(tokens: DataFrame, memory: DataFrame, keys: list[str], most: int = 20_000, seed: int = 42) -> DataFrame:
    """(keys, heatmap): 1 - the highest cosine of each patch to any of at most ``most`` memory patches."""
    each = lambda df, *k: df.select(*k, F.posexplode(F.transform("tokens", V.l2_normalize)).alias("patch", "token"))
    bank = each(memory, "image_path").orderBy(F.xxhash64("image_path", "patch", F.lit(seed)), "image_path", "patch").limit(most)
    scores = classify.nearest_memory(each(tokens, *keys), bank, [*keys, "patch"])
    flat = F.transform(F.array_sort(F.collect_list(F.struct("patch", "score"))), lambda s: s["score"])
    return scores.groupBy(*keys).agg(V.scores_to_grid(flat).alias("heatmap"))
