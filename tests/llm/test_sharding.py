import hashlib
from collections import defaultdict

from regionloom.llm import sharding


def bits(doc_id, text):
    inner = hashlib.md5((text or "").encode()).hexdigest()
    key = f"{'' if doc_id is None else doc_id}:{inner}"
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def plain(rows, limit):
    """Buckets that are too large, and only those, split on the next bit."""
    todo, done = [(0, 0, rows)], {}
    while todo:
        depth, prefix, inside = todo.pop()
        if sum(r[1] for r in inside) <= limit or len(inside) == 1 or depth == 60:
            done[f"{depth}:{prefix}"] = inside
            continue
        halves = defaultdict(list)
        for r in inside:
            halves[r[0] >> (59 - depth)].append(r)
        todo += [(depth + 1, p, v) for p, v in halves.items()]
    return done


def test_against_splitting_one_by_one(spark):
    rows = [(i, "x" * (i * 37 % 900)) for i in range(500)] + [(None, "null id"), (7, None), (7, "big" * 2000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, shard string")
    for limit in (1000, 5000, 1 << 30):
        want = plain([(bits(*r), len((r[1] or "").encode()), r[0]) for r in rows], limit)
        got = defaultdict(list)
        for r in sharding.assign_shards(docs, limit).collect():
            got[r.shard].append(r)
        assert {k: sorted(map(str, (x[2] for x in v))) for k, v in want.items()} == {k: sorted(str(x.doc_id) for x in v) for k, v in got.items()}
        for v in got.values():
            assert sum(x.bytes for x in v) == v[0].shard_bytes and (v[0].shard_bytes <= limit or (len(v) == 1 and v[0].oversized))


def test_equal_rows_are_dealt(spark):
    docs = spark.createDataFrame([(1, "x" * 100)] * 50 + [(None, None)] * 3, "doc_id long, text string")
    got = defaultdict(int)
    for r in sharding.assign_shards(docs, 250).collect():
        got[r.shard] += r.bytes
        assert not r.oversized
    assert len(got) == 26 and max(got.values()) == 200
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 90), "h") for i in range(300)] + [(5, "a" * 5, "dup")], "doc_id long, text string, h string")
    sharding.write_shards(docs, str(tmp_path / "s"), 2000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(tuple, back.select("doc_id", "text", "h").collect())) == sorted(map(tuple, docs.collect()))
    sizes = back.selectExpr("_shard", "octet_length(text) b").groupBy("_shard").sum("b").collect()
    assert all(r[1] <= 2000 for r in sizes) and {r[0] for r in sizes} == {r.shard for r in sharding.assign_shards(docs, 2000).collect()}
