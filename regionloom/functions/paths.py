"""What paths and labels say, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Split names in paths (fixed values).
SPLIT_ALIASES = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "test": "test", "testing": "test"}
#: File suffixes of images (fixed values).
IMAGE_SUFFIXES = (".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalize_path(path: Column) -> Column:
    return strip(slashes(path))


def key_variants(path: Column) -> Column:
    """The keys under which a path may be stored, first to last."""
    posix = F.regexp_replace(F.regexp_replace(F.regexp_replace(slashes(path), r"/(\./)+|/{2,}", "/"), r"^(\./)+", ""), "(?<=[^/])/$", "")
    return F.array_distinct(F.array(path, slashes(path), posix))


def normalize_label(label: Column) -> Column:
    return F.coalesce(F.nullif(F.translate(strip(label), " /", "__"), F.lit("")), F.lit("unknown_defect"))


def is_image(path: Column) -> Column:
    return F.lower(path).rlike("(" + "|".join(s.replace(".", r"\.") for s in IMAGE_SUFFIXES) + ")$")


def _folders(parts: Column) -> Column:
    return F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lower)


def _aliases() -> Column:
    return F.array(*[F.lit(a) for a in SPLIT_ALIASES])


def infer_split(relative: Column) -> Column:
    """The split that the first folder with such a name gives; null if none."""
    alias = F.create_map(*[F.lit(x) for pair in SPLIT_ALIASES.items() for x in pair])
    first = F.get(F.filter(_folders(F.split(relative, "/")), lambda x: F.array_contains(_aliases(), x)), F.lit(0))
    return F.try_element_at(alias, first)


def split_index(parts: Column) -> Column:
    """Zero-based place of the first folder that names a split; -1 if none."""
    at = F.transform(_folders(parts), lambda x, i: F.when(F.array_contains(_aliases(), x), i).otherwise(-1))
    return F.coalesce(F.get(F.filter(at, lambda i: i >= 0), F.lit(0)), F.lit(-1))


def infer_object(relative: Column) -> Column:
    parts = F.split(relative, "/")
    at = split_index(parts)
    return F.when(at > 0, F.get(parts, at - 1)).when(F.size(parts) >= 2, F.get(parts, F.lit(0))).otherwise("unknown_object")


def infer_defect(relative: Column, labels: Column | None = None, root_name: str = "") -> Column:
    """First annotated label, else the folder after the split's, else the parent folder."""
    parts = F.split(relative, "/")
    at, n = split_index(parts), F.size(parts)
    by_path = F.when((at >= 0) & (at + 1 < n - 1), F.get(parts, at + 1)).when(n >= 3, F.get(parts, n - 2)).when(n == 2, F.get(parts, F.lit(0))).otherwise(root_name)
    first = F.get(labels, F.lit(0)) if labels is not None else F.lit(None).cast("string")
    return normalize_label(F.coalesce(first, by_path))


def mask_path(folder: str, image: Column) -> Column:
    """Where a mask is written: the image's place below ``folder``, an absolute path as one name."""
    path = slashes(image)
    relative = F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(".png"))
    name = F.replace(F.replace(F.regexp_replace(path, "^/+|/+$", ""), F.lit(":"), F.lit("")), F.lit("/"), F.lit("__"))
    return F.when(path.startswith("/"), F.concat(F.lit(folder.rstrip("/") + "/"), name, F.lit(".png"))).otherwise(relative)


def escape_cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))
