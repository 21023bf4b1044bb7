"""Feature vectors as Column expressions over ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    """Sum from left to right, as a loop does it."""
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def parse_spaced(text: Column) -> Column:
    """Numbers parted by white space; a word that is no number is an error."""
    parts = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.transform(parts, lambda x: x.cast("double"))


def parse_vector(text: Column) -> Column:
    """A JSON list, or numbers parted by commas or white space."""
    trimmed = F.trim(text)
    return F.when(trimmed.startswith("["), F.from_json(trimmed, "array<double>")).otherwise(parse_spaced(F.replace(trimmed, F.lit(","), F.lit(" "))))


def dot(a: Column, b: Column) -> Column:
    product = total(F.zip_with(a, b, lambda x, y: x * y))
    message = F.concat(F.lit("vector lengths differ: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(message).cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit length; a vector shorter than ``EPSILON`` becomes zeros."""
    return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n < EPSILON, F.lit(0.0)).otherwise(x / n)))


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def fuse(whole: Column, region: Column, method: str = "concat", alpha: float = 0.5, normalize_input: bool = False, normalize_output: bool = False) -> Column:
    """Concatenation, or alpha * whole + (1 - alpha) * region."""
    if method not in ("concat", "weighted-sum"):
        raise ValueError(f"unknown fusion method: {method}")
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")
    if normalize_input:
        whole, region = l2_normalize(whole), l2_normalize(region)
    if method == "concat":
        out = F.concat(whole, region)
    else:
        mixed = F.zip_with(whole, region, lambda x, y: alpha * x + (1 - alpha) * y)
        message = F.lit("weighted fusion needs vectors of one length")
        out = F.when(F.size(whole) == F.size(region), mixed).otherwise(F.raise_error(message).cast("array<double>"))
    return l2_normalize(out) if normalize_output else out


def min_max(v: Column) -> Column:
    """To 0 .. 1; zeros if lowest and highest agree to a part in 1e9."""
    low, high = F.array_min(v), F.array_max(v)
    flat = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(low), F.abs(high))
    return let(F.struct(low.alias("l"), high.alias("h"), flat.alias("f")), lambda s: F.transform(v, lambda x: F.when(s["f"], F.lit(0.0)).otherwise((x - s["l"]) / (s["h"] - s["l"]))))


def square_side(v: Column) -> Column:
    """Side of the square grid that ``v`` fills; an error if it fills none."""
    side = F.floor(F.sqrt(F.size(v))).cast("int")
    message = F.concat(F.lit("no square grid: "), F.size(v).cast("string"))
    return F.when(side * side == F.size(v), side).otherwise(F.raise_error(message).cast("int"))


def rows_of(v: Column, width: Column) -> Column:
    """A flat array cut into rows."""
    return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / w).cast("int") - 1), lambda r: F.slice(v, r * w + 1, w)))


def scores_to_grid(v: Column) -> Column:
    """Patch scores, normalised, as a square grid."""
    return let(min_max(v), lambda n: rows_of(n, square_side(n)))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str) -> DataFrame:
    """Element-wise mean of ``vector`` for each key: partial sums leave the map side, not vectors."""
    each = df.select(*keys, F.posexplode(vector).alias("_pos", "_x"))
    means = each.groupBy(*keys, "_pos").agg(F.avg("_x").alias("_m"))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_m")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda s: s["_m"]).alias(out))


def patch_contrast(tokens: Column) -> Column:
    """1 - cosine of each patch token to the mean token; ``tokens`` are normalised rows."""
    n = F.size(tokens)
    zero = F.transform(tokens[0], lambda x: F.lit(0.0))
    added = F.aggregate(tokens, zero, lambda acc, t: F.zip_with(acc, t, lambda x, y: x + y))
    center = l2_normalize(F.transform(added, lambda x: x / n))
    return let(center, lambda c: F.transform(tokens, lambda t: 1 - dot(t, c)))
