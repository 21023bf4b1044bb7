"""Heatmaps as ARRAY<ARRAY<DOUBLE>>, rows from the top: built-in expressions for what needs no neighbours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let, total

GRID = "array<array<double>>"


def width(h: Column) -> Column:
    return F.coalesce(F.size(F.get(h, F.lit(0))), F.lit(0))


def height(h: Column) -> Column:
    return F.size(h)


def is_rectangular(h: Column) -> Column:
    """Non-empty, all rows as long as the first, all values finite."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce((F.size(h) > 0) & (width(h) > 0) & F.forall(h, lambda r: (F.size(r) == width(h)) & F.forall(r, finite)), F.lit(False))


def _kth(sorted_values: Column, index: Column) -> Column:
    n = F.size(sorted_values)
    return F.element_at(sorted_values, F.least(n - 1, F.greatest(F.lit(0), index.cast("int"))) + 1)


def threshold(values: Column, percentile: Column | float) -> Column:
    """The value at index ceil(p * (n - 1)) in ascending order; neither percentile_disc nor an interpolation."""
    p = percentile if isinstance(percentile, Column) else F.lit(float(percentile))
    return let(F.sort_array(values), lambda s: _kth(s, F.ceil(p * (F.size(s) - 1))))


def threshold_by_count(values: Column, percentile: Column | float) -> Column:
    """The value at index int(p * n) - 1 in ascending order: the simple mask's rule."""
    p = percentile if isinstance(percentile, Column) else F.lit(float(percentile))
    return let(F.sort_array(values), lambda s: _kth(s, F.floor(p * F.size(s)) - 1))


def above(h: Column, t: Column) -> Column:
    return F.transform(h, lambda r: F.transform(r, lambda v: v >= t))


def peak(values: Column) -> Column:
    """Zero-based place of the first maximum of a flat array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def min_area(cells: Column, ratio: Column | float) -> Column:
    r = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    return F.greatest(F.lit(1), F.bround(cells.cast("double") * r).cast("int"))


def resize_bilinear(h: Column, to_width: Column, to_height: Column) -> Column:
    """Pixel centres aligned, edges clamped."""

    def axis(n: Column, to: Column) -> Column:
        def place(t: Column) -> Column:
            at = (t + 0.5) * (n.cast("double") / to) - 0.5
            first = F.greatest(F.lit(0), F.least(n - 1, F.floor(at).cast("int")))
            return F.struct(first.alias("a"), F.least(n - 1, first + 1).alias("b"), F.when(at < 0, F.lit(0.0)).otherwise(at - first).alias("w"))

        return F.transform(F.sequence(F.lit(0), to - 1), place)

    mix = lambda x, y, w: x * (1 - w) + y * w

    def row(y: Column, xs: Column) -> Column:
        return let(F.struct(F.get(h, y["a"]).alias("t"), F.get(h, y["b"]).alias("u")), lambda two: F.transform(xs, lambda x: mix(mix(F.get(two["t"], x["a"]), F.get(two["t"], x["b"]), x["w"]), mix(F.get(two["u"], x["a"]), F.get(two["u"], x["b"]), x["w"]), y["w"])))

    resized = let(axis(width(h), to_width), lambda xs: F.transform(axis(height(h), to_height), lambda y: row(y, xs)))
    return F.when((width(h) == to_width) & (height(h) == to_height), h).otherwise(resized)


def resize_nearest(mask: Column, to_width: Column, to_height: Column) -> Column:
    place = lambda n, t, to: F.least(n - 1, F.floor(t * n / to).cast("int"))
    return F.transform(F.sequence(F.lit(0), to_height - 1), lambda y: let(F.get(mask, place(height(mask), y, to_height)), lambda r: F.transform(F.sequence(F.lit(0), to_width - 1), lambda x: F.get(r, place(F.size(r), x, to_width)))))


def mask_area(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda acc, r: acc + F.size(F.filter(r, lambda v: v)))


def tight_box(mask: Column) -> Column:
    """The least box around true cells; (0, 0, 1, 1) if there are none."""
    hit = F.filter(F.transform(mask, lambda r, y: F.struct(y.alias("y"), F.array_position(r, True).alias("a"), (F.size(r) + 1 - F.array_position(F.reverse(r), True)).alias("b"))), lambda s: s["a"] > 0)

    def made(rows: Column) -> Column:
        part = lambda f: F.transform(rows, f)
        found = F.struct((F.array_min(part(lambda s: s["a"])) - 1).cast("double").alias("x1"), F.array_min(part(lambda s: s["y"])).cast("double").alias("y1"), F.array_max(part(lambda s: s["b"])).cast("double").alias("x2"), (F.array_max(part(lambda s: s["y"])) + 1).cast("double").alias("y2"))
        none = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(1.0).alias("x2"), F.lit(1.0).alias("y2"))
        return F.when(F.size(rows) > 0, found).otherwise(none)

    return let(hit, made)


def simple_mask(h: Column, percentile: float = 0.9, least: int = 1) -> Column:
    """STRUCT<values, threshold, area, confidence>: thresholded cells, or all cells equal to the peak if they are too few."""

    def made(flat: Column) -> Column:
        t = threshold_by_count(flat, percentile)

        def chosen(t: Column) -> Column:
            enough = F.size(F.filter(flat, lambda v: v >= t)) >= least
            return F.when(enough, F.struct(t.alias("t"), F.lit(False).alias("peak"))).otherwise(F.struct(F.array_max(flat).alias("t"), F.lit(True).alias("peak")))

        def result(c: Column) -> Column:
            keep = lambda v: F.when(c["peak"], v == c["t"]).otherwise(v >= c["t"])
            kept = F.filter(flat, keep)
            return let(kept, lambda k: F.struct(F.transform(h, lambda r: F.transform(r, keep)).alias("values"), c["t"].alias("threshold"), F.size(k).alias("area"), F.when(F.size(k) > 0, total(k) / F.size(k)).otherwise(0.0).alias("confidence")))

        return let(let(t, chosen), result)

    return let(F.flatten(h), made)
