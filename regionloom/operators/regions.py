"""Heatmap to box or mask: thresholding, 4-connected components and their choice.

Components need neighbours, which no built-in expression has, so one kernel
labels a grid in numpy; area filters, choice, scaling and ranking stay
relational.  A sweep labels each (heatmap, percentile) once, whatever the
number of area ratios and component rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import grids as G

COMPONENTS = "percentile double, comp int, area int, score double, cx1 int, cy1 int, cx2 int, cy2 int, is_peak boolean, grid_width int, grid_height int, threshold double"


def label_components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected components numbered from 1 in raster order of their first cell: runs of rows, joined with the runs above."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    edge = np.diff(padded, axis=1)
    rows, begins = np.nonzero(edge == 1)
    ends = np.nonzero(edge == -1)[1]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(h + 1)).tolist()
    b, e = begins.tolist(), ends.tolist()
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if b[i] < e[j] and b[j] < e[i]:
                p, q = root(i), root(j)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            if e[i] < e[j]:
                i += 1
            else:
                j += 1
    out, names = np.zeros((h, w), np.int32), {}
    for i, y in enumerate(rows.tolist()):
        out[y, b[i] : e[i]] = names.setdefault(root(i), len(names) + 1)
    return out, len(names)


def bilinear(grid: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = grid.shape
    if (w, h) == (width, height):
        return grid

    def axis(n: int, to: int):
        at = (np.arange(to) + 0.5) * (n / to) - 0.5
        a = np.clip(np.floor(at).astype(np.int64), 0, n - 1)
        return a, np.minimum(n - 1, a + 1), np.where(at < 0, 0.0, at - a)

    xa, xb, xw = axis(w, width)
    ya, yb, yw = axis(h, height)
    across = grid[:, xa] * (1 - xw) + grid[:, xb] * xw
    return across[ya] * (1 - yw)[:, None] + across[yb] * yw[:, None]


def threshold_of(flat: np.ndarray, percentile: float) -> float:
    k = min(len(flat) - 1, max(0, math.ceil(percentile * (len(flat) - 1))))
    return float(np.partition(flat, k)[k])


def _measured(grid: np.ndarray, percentile: float) -> list[tuple]:
    t = threshold_of(grid.ravel(), percentile)
    labels, n = label_components(grid >= t)
    ys, xs = np.nonzero(labels)
    of = labels[ys, xs] - 1
    area, total = np.bincount(of, minlength=n), np.bincount(of, grid[ys, xs], minlength=n)
    edges = []
    for v, least in ((xs, True), (ys, True), (xs, False), (ys, False)):
        out = np.full(n, np.iinfo(np.int64).max if least else -1)
        (np.minimum if least else np.maximum).at(out, of, v)
        edges.append(out)
    h, w = grid.shape
    rows = [(percentile, i, int(area[i]), float(total[i] / area[i]), *(int(e[i]) for e in edges), False, w, h, t) for i in range(n)]
    y, x = divmod(int(grid.argmax()), w)
    return [*rows, (percentile, -1, 1, float(grid[y, x]), x, y, x, y, True, w, h, t)]


def _grid(rows) -> np.ndarray:
    grid = np.array([np.asarray(r, np.float64) for r in rows], np.float64)
    if grid.ndim != 2 or not grid.size:
        raise ValueError("a heatmap must be a rectangle with cells")
    return grid


def _size(value, default: int, needed: bool) -> int:
    n = 0 if value is None or value != value else int(value)
    if n <= 0 and needed:
        raise ValueError("image_width and image_height are needed for upsampling")
    return n if n > 0 else default


def component_table(heatmaps: DataFrame, percentiles: list[float], keys: list[str], upsample: bool = False) -> DataFrame:
    """(keys, COMPONENTS) of ``heatmaps`` (keys, heatmap, image_width, image_height): each component, and the peak cell as a fallback."""
    for p in percentiles:
        if not 0 < p <= 1:
            raise ValueError("percentile must be in (0, 1]")
    kept = [heatmaps.schema[k] for k in keys]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + COMPONENTS + ", image_width int, image_height int"

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, "percentile", "comp", "area", "score", "cx1", "cy1", "cx2", "cy2", "is_peak", "grid_width", "grid_height", "threshold", "image_width", "image_height"]
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                key, grid = tuple(r[: len(keys)]), _grid(r.heatmap)
                w, h = _size(r.image_width, grid.shape[1], upsample), _size(r.image_height, grid.shape[0], upsample)
                work = bilinear(grid, w, h) if upsample else grid
                rows += [(*key, *m, w, h) for p in percentiles for m in _measured(work, p)]
            yield pd.DataFrame(rows, columns=names)

    return heatmaps.select(*keys, "heatmap", F.col("image_width").cast("int").alias("image_width"), F.col("image_height").cast("int").alias("image_height")).mapInPandas(made, ddl)


def choose(components: DataFrame, keys: list[str], settings: DataFrame) -> DataFrame:
    """The chosen component of each (keys, setting): ``settings`` has setting_idx, percentile, min_area_ratio, component.

    Those below the least area go; if none is left the peak stands in.  Equal components go in raster order.
    """
    each = components.join(settings, "percentile")
    cells = F.col("grid_width") * F.col("grid_height")
    each = each.where(F.col("is_peak") | (F.col("area") >= G.min_area(cells, F.col("min_area_ratio"))))
    largest = F.col("component") == "largest"
    a, s = F.col("area").cast("double"), F.col("score")
    order = [F.col("is_peak").asc(), F.when(largest, a).otherwise(s).desc(), F.when(largest, s).otherwise(a).desc(), F.col("comp").asc()]
    best = each.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "setting_idx").orderBy(*order))).where("_r = 1").drop("_r")
    sx, sy = F.col("image_width") / F.col("grid_width"), F.col("image_height") / F.col("grid_height")
    made = B.box(F.col("cx1") * sx, F.col("cy1") * sy, F.least(F.col("image_width").cast("double"), (F.col("cx2") + 1) * sx), F.least(F.col("image_height").cast("double"), (F.col("cy2") + 1) * sy))
    return best.withColumn("box", made)


def settings_table(spark, percentiles: list[float], ratios: list[float], components: list[str]) -> DataFrame:
    """The sweep's settings in their order: percentile, then area ratio, then component."""
    if bad := [c for c in components if c not in ("largest", "max-score")]:
        raise ValueError(f"unknown component rules: {bad}")
    if any(r < 0 for r in ratios):
        raise ValueError("area ratios must not be negative")
    rows = [(p, r, c) for p in percentiles for r in ratios for c in components]
    return spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "setting_idx int, percentile double, min_area_ratio double, component string")


def heatmap_boxes(heatmaps: DataFrame, keys: list[str], percentile: float = 0.9, min_area_ratio: float = 0.001, component: str = "max-score", upsample: bool = False) -> DataFrame:
    """(keys, box, score, area): area counts grid cells, or pixels when upsampled."""
    one = settings_table(heatmaps.sparkSession, [percentile], [min_area_ratio], [component])
    return choose(component_table(heatmaps, [percentile], keys, upsample), keys, one).select(*keys, "box", "score", "area")


def nearest(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = mask.shape
    place = lambda n, to: np.minimum(n - 1, (np.arange(to) * n / to).astype(np.int64))
    return mask[place(h, height)][:, place(w, width)]


def select_mask(grid: np.ndarray, percentile: float, ratio: float, component: str) -> tuple[np.ndarray, float]:
    """(kept cells, score): the components chosen, or the peak cell; the score is weighted by area."""
    labels, n = label_components(grid >= threshold_of(grid.ravel(), percentile))
    least = max(1, int(round(grid.size * ratio)))
    area = np.bincount(labels.ravel(), minlength=n + 1)[1:]
    total = np.bincount(labels.ravel(), grid.ravel(), minlength=n + 1)[1:]
    kept = [i for i in range(n) if area[i] >= least]
    if not kept:
        mask = np.zeros(grid.shape, bool)
        mask.flat[int(grid.argmax())] = True
        return mask, float(grid.max())
    if component != "all":
        key = (lambda i: (area[i], total[i] / area[i])) if component == "largest" else (lambda i: (total[i] / area[i], area[i]))
        kept = [max(kept, key=key)]
    return np.isin(labels, [i + 1 for i in kept]), float(total[kept].sum() / area[kept].sum())


def heatmap_masks(heatmaps: DataFrame, keys: list[str], percentile: float = 0.9, min_area_ratio: float = 0.001, component: str = "all", upsample: bool = False) -> DataFrame:
    """(keys, mask, box, score, area, heatmap_processing): the mask and its area in image pixels."""
    if not 0 < percentile <= 1 or min_area_ratio < 0 or component not in ("all", "largest", "max-score"):
        raise ValueError("percentile, area ratio or component rule out of range")
    kept = [heatmaps.schema[k] for k in keys]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", mask array<array<boolean>>, score double"

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                grid = _grid(r.heatmap)
                w, h = _size(r.image_width, grid.shape[1], upsample), _size(r.image_height, grid.shape[0], upsample)
                mask, score = select_mask(bilinear(grid, w, h) if upsample else grid, percentile, min_area_ratio, component)
                rows.append((*r[: len(keys)], (mask if upsample else nearest(mask, w, h)).tolist(), score))
            yield pd.DataFrame(rows, columns=[*keys, "mask", "score"])

    out = heatmaps.select(*keys, "heatmap", F.col("image_width").cast("int").alias("image_width"), F.col("image_height").cast("int").alias("image_height")).mapInPandas(made, ddl)
    return out.select(*keys, "mask", G.tight_box(F.col("mask")).alias("box"), "score", G.mask_area(F.col("mask")).alias("area"), F.lit("bilinear_to_image" if upsample else "native_grid").alias("heatmap_processing"))
