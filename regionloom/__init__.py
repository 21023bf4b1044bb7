"""regionloom: a Spark-first engine for region-aware few-shot evaluation data.

Functions take and return DataFrames or Columns; Catalyst plans them.  The few
Python kernels are shipped to the executors by value, so a cluster needs no
installed copy of this package.
"""

import importlib
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

#: What the package gives by name, imported when it is asked for.
_FROM = {
    "sources.readers": ["load_features", "load_fusion_cache", "load_heatmaps", "load_manifest"],
    "operators.episodes": ["assign_splits", "hash_features", "sample", "sample_hashed"],
    "operators.classify": ["fuse_scores", "nearest_memory", "prototypes", "score"],
    "operators.metrics": ["compare_per_class", "confusion", "per_class", "scores"],
    "operators.regions": ["heatmap_boxes", "heatmap_masks"],
    "operators.merge": ["fuse_caches", "merge_duplicates"],
    "operators.extract": ["Extractor", "Localizer", "extract_features", "localize"],
    "functions.grids": ["simple_mask"],
    "plans.build": ["HeatmapPipeline", "image_manifest", "pseudo_boxes", "pseudo_masks"],
    "plans.evaluation": ["few_shot_grid"],
}
_PLACE = {name: module for module, names in _FROM.items() for name in names}
__all__ = sorted(_PLACE)


def __getattr__(name: str):
    if name not in _PLACE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_PLACE[name]}"), name)
