"""Boxes as STRUCT<x1, y1, x2, y2: DOUBLE>, half open; text at the edges only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import let

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.cast("double").alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True)])


def parts(text: Column) -> Column:
    """The parts of a box's text between commas or semicolons."""
    return F.split(F.translate(text, ";", ","), ",")


def numbers(p: Column) -> Column:
    """STRUCT<x1, y1, x2, y2> of four ``parts``, empty ones between them dropped; fields that are no number are null.

    Four parts, the usual case, need no array function and stay in generated code.
    """
    full = F.filter(p, lambda x: F.trim(x) != "")
    usual = box(*[F.get(p, F.lit(i)).try_cast("double") for i in range(4)])
    odd = let(full, lambda q: F.when(F.size(q) == 4, box(*[F.get(q, F.lit(i)).try_cast("double") for i in range(4)])))
    return F.when(F.size(p) == 4, usual).when(F.size(p) > 4, odd)


def valid(b: Column) -> Column:
    """``b`` if it has four numbers and an area."""
    # NaN passes every comparison of the original but not Spark's, where it is the largest number
    least = lambda lo, hi: F.isnan(lo) | F.isnan(hi) | (hi > lo)
    given = b["x1"].isNotNull() & b["y1"].isNotNull() & b["x2"].isNotNull() & b["y2"].isNotNull()
    return F.when(given & least(b["x1"], b["x2"]) & least(b["y1"], b["y2"]), b)


def parse_box(text: Column) -> Column:
    """A box from text; null for blank, malformed or degenerate ones."""
    return let(numbers(parts(text)), valid)


def parse_box_strict(text: Column) -> Column:
    """The same, but text that is there and no box is an error."""
    found = parse_box(text)
    blank = text.isNull() | (F.trim(text) == "")
    return F.when(blank, F.lit(None).cast(BOX)).otherwise(F.coalesce(found, F.raise_error(F.concat(F.lit("no box: "), text)).cast(BOX)))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x1", "x2") * side("y1", "y2")


def iou(a: Column, b: Column) -> Column:
    shared = intersection(a, b)
    # boxes that share an area have a union
    return F.when(shared > 0, shared / (area(a) + area(b) - shared)).when(shared.isNotNull(), 0.0)


def area_ratio(pseudo: Column, truth: Column) -> Column:
    return F.when(area(truth) > 0, area(pseudo) / area(truth)).otherwise(float("inf"))


def padded_crop(b: Column, width: Column, height: Column, padding: float = 0.15, least: int = 32) -> Column:
    """STRUCT<left, top, right, bottom: INT> around a box, moved into the image; a null box gives the whole image."""

    def span(lo: Column, hi: Column, limit: Column) -> Column:
        """STRUCT<a, b> of whole pixels; each step is bound once, as the next uses it more than once."""
        pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        want = F.greatest((hi - lo) + 2 * ((hi - lo) * padding), F.lit(float(least)))
        half, middle = want / 2, (lo + hi) / 2
        low = lambda s: pair(F.greatest(s["a"], F.lit(0.0)), F.when(s["a"] < 0, s["b"] - s["a"]).otherwise(s["b"]))
        high = lambda s: pair(F.greatest(F.when(s["b"] > limit, s["a"] - (s["b"] - limit)).otherwise(s["a"]), F.lit(0.0)), F.least(s["b"], limit.cast("double")))
        first = lambda s: F.greatest(F.lit(0), F.least(limit - 1, s["a"].cast("int")))
        whole = lambda s: let(first(s), lambda f: pair(f, F.greatest(f + 1, F.least(limit, F.bround(s["b"]).cast("int")))))
        return let(half, lambda d: let(let(let(pair(middle - d, middle + d), low), high), whole))

    w, h = width.cast("int"), height.cast("int")
    named = lambda x, y: F.struct(x["a"].alias("left"), y["a"].alias("top"), x["b"].alias("right"), y["b"].alias("bottom"))
    found = let(F.struct(span(b["x1"], b["x2"], w).alias("x"), span(b["y1"], b["y2"], h).alias("y")), lambda s: named(s["x"], s["y"]))
    whole = F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), w.alias("right"), h.alias("bottom"))
    return F.when(b.isNull(), whole).otherwise(found)


@F.pandas_udf(T.StringType())
def format_box(boxes: pd.DataFrame) -> pd.Series:
    """'x1,y1,x2,y2' with two decimals of the exact binary value, which JVM formatting rounds otherwise."""
    rows = boxes[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None)
    return pd.Series([None if any(v is None for v in r) or any(v != v for v in r) else ",".join(f"{v:.2f}" for v in r) for r in rows], dtype="object")


@F.pandas_udf(T.StringType())
def six_decimals(values: pd.Series) -> pd.Series:
    """A number with six decimals of its exact binary value; null stays null."""
    return pd.Series([None if v is None or v != v else f"{v:.6f}" for v in values], dtype="object")
