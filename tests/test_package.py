import pytest

import regionloom
from regionloom.plans.build import HeatmapPipeline


def test_exports():
    assert all(getattr(regionloom, name) is not None for name in regionloom.__all__)
    with pytest.raises(AttributeError):
        regionloom.no_such_name  # noqa: B018


def test_settings_from_the_environment():
    made = lambda env: HeatmapPipeline.from_env(None, "m.csv", "out", ["h.jsonl"], env=env)
    assert made({}) == made({"SPLIT": "", "RUN_PSEUDO_MASK": "1"}) == HeatmapPipeline(None, "m.csv", "out", ["h.jsonl"])
    got = made({"SPLIT": "val", "PERCENTILE": "0.8", "EPISODES": "7", "Q_QUERIES": "3", "BBOX_COMPONENT": "largest", "VALIDATE_HEATMAPS": "0", "RUN_PSEUDO_MASK": "0"})
    assert (got.split, got.percentile, got.episodes, got.queries, got.box_component) == ("val", 0.8, 7, 3, "largest")
    assert got.stages == ("merge", "dedupe", "boxes", "evaluate")
