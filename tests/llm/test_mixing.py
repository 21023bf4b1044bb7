from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from regionloom.llm import mixing


def corpus(spark, n=400):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None, "x") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in free}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        free -= full
    return target


def test_targets_and_taken(spark):
    docs = corpus(spark)
    kinds = {r.doc_id: r.source for r in docs.collect()}
    options = {"block_words": 300, "shard_words": 2000}
    rows = mixing.taken(docs, **options).collect()
    sizes, took = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[kinds[r.doc_id]] += r["size"]
        took[kinds[r.doc_id]] += r.taken
        assert r.taken in (0, r["size"], 2 * r["size"])
    want = plain_targets(sizes)
    for r in rows:
        s = kinds[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
    for s, w in want.items():
        assert abs(took[s] - w) <= 40
    again = mixing.taken(docs.repartition(7), **options).collect()
    assert sorted((r.doc_id, r.taken, r.shards) for r in rows) == sorted((r.doc_id, r.taken, r.shards) for r in again)


def test_mix_gives_rows_as_often_as_taken(spark):
    docs = corpus(spark)
    m = mixing.Mixture(docs, block_words=300, shard_words=2000)
    want = {r.doc_id: len(r.shards) for r in m.taken().collect() if r.shards}
    out = m.mix()
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want


def test_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(0, 57), (1, 1), (2, 0), (3, 200)], "sid int, k long")
    rows = mixing.split_quotas(quotas, 13, 3).collect()
    by_source, by_shard = defaultdict(int), defaultdict(int)
    for r in rows:
        by_source[r.sid] += r.k
        by_shard[r.shard] += r.k
    assert dict(by_source) == {0: 57, 1: 1, 3: 200}
    assert len(by_shard) == 13 and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_tree_is_hypergeometric(spark):
    # the first of two shards gets half of source 0's 10 of 40 blocks, with the variance of draws without replacement
    draws = [sum(r.k for r in mixing.split_quotas(spark.createDataFrame([(0, 10), (1, 30)], "sid int, k long"), 2, seed).where("shard = 0 and sid = 0").collect()) for seed in range(60)]
    mean = sum(draws) / 60
    assert 4.2 < mean < 5.8
    assert 0.8 < sum((d - mean) ** 2 for d in draws) / 59 < 3.6


def test_defined_cases(spark):
    docs = spark.createDataFrame([(None, None, None, "x"), (1, "a b c", None, "y"), (1, "a b c", None, "y"), (2, "", "s", "z")], "doc_id long, text string, source string, size string")
    rows = mixing.taken(docs).collect()
    assert len(rows) == 4 and {(r.doc_id, r["size"], r.source_size) for r in rows} == {(None, 0, 6), (1, 3, 6), (2, 0, 0)}
    assert mixing.taken(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.taken(docs, most=3)
    assert mixing.mix(docs.withColumn("row", F.lit(1)).withColumn("key", F.lit(2))).columns == [*docs.columns, "row", "key"]
