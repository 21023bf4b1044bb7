import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from regionloom import queries as core
from regionloom.plans import evaluation

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@needs_data
@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_rows_equal_those_of_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = db.sql(core.ORACLE[name]), core.QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    at = [want.columns.index(c) for c in got.columns]
    rows = lambda r, order: sorted((tuple(plain(x[i]) for i in order) for x in r), key=repr)
    assert rows(got.collect(), range(len(at))) == rows(want.fetchall(), at)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_registry():
    names = entry.queries()
    assert set(core.QUERIES) <= set(names) and set(entry.oracle_sql()) <= set(names)
    assert ("pipeline" in names) == bool(entry._llm and entry._pipeline)
    assert all(callable(f) for f in names.values())


@needs_data
def test_grid_without_sql(spark):
    rows = core.QUERIES["few_shot_grid"](spark, SF).orderBy("setting_idx").collect()
    assert [(r.n_way, r.k_shot) for r in rows] == [(5, 1), (5, 3), (5, 5), (10, 1), (10, 5)]
    assert all(0 <= r.accuracy_mean <= 1 and r.accuracy_stdev >= 0 for r in rows)


def test_every_image_against_the_whole_memory(spark, tmp_path):
    """No image and no row of label 0 is left out, whatever its number."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=64).tolist(), i % 3) for i in range(70)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = {i: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(np.float32(v).astype(float).reshape(8, 8)) for i, v, _ in rows}
    memory = np.concatenate([unit[i] for i, _, label in rows if label == 0])
    want = {(i, k): 1 - (memory @ t).max() for i in unit for k, t in enumerate(unit[i])}
    got = {(r.vec_id, r.patch): r.score for r in core.QUERIES["nearest_memory"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len(got) == 560
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


@needs_data
def test_fused_grid_runs_every_setting_and_episode(spark, monkeypatch):
    drawn = []
    sample = evaluation.episodes.sample
    monkeypatch.setattr(evaluation.episodes, "sample", lambda *a, **k: drawn.append(sample(*a, **k)) or drawn[-1])
    rows = core.QUERIES["region_context_episodes"](spark, SF).collect()
    settings = [(5, 1), (5, 3), (5, 5), (10, 1), (10, 5)]
    assert sorted((r.whole_weight, r.n_way, r.k_shot, r.episodes) for r in rows) == sorted((w, *s, 200) for w in (0.25, 0.5, 0.75) for s in settings)
    assert all(0 <= r.accuracy_mean <= 1 and r.accuracy_stdev >= 0 for r in rows)
    assert drawn[0].select("setting_idx", "episode_idx").distinct().count() == 1000


def test_caches_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """No row of a JSON lines cache or manifest comes to the driver, and its parts are read back in order, whatever that of the table."""
    rng = np.random.default_rng(9)
    vectors = {i: np.float32(rng.normal(size=64)).astype(float) for i in range(500)}
    rows = [(int(i), vectors[i].tolist(), 0) for i in rng.permutation(500)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7).write.parquet(str(tmp_path / "embeddings.parquet"))
    parts = spark.range(400).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.col("id").cast("int").alias("p_size"))
    parts.repartition(5).write.parquet(str(tmp_path / "part.parquet"))
    frame = type(parts)

    def refused(*a, **k):
        raise AssertionError("rows came to the driver")

    with monkeypatch.context() as m:
        for name in ("collect", "toLocalIterator", "toPandas", "toArrow"):
            m.setattr(frame, name, refused)
        cache = core.QUERIES["feature_cache_jsonl"](spark, str(tmp_path))
        manifest = core.QUERIES["manifest_jsonl_split"](spark, str(tmp_path))
    last = {f"f{k}": vectors[max(i for i in vectors if i % 70 == k)] for k in range(70)}
    got = {r.key: (r.n, r.place_sum) for r in cache.collect()}
    assert got.keys() == last.keys()
    assert all(got[k][0] == 64 and abs(got[k][1] - v @ np.arange(1, 65)) < 1e-5 for k, v in last.items())
    assert sorted((r.row_idx, r.image_path) for r in manifest.collect()) == [(k, f'i/{k}, "x".png') for k in range(400) if k % 3 != 1]
