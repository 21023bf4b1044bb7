import random
from collections import defaultdict

from pyspark.sql import functions as F

from regionloom.llm import packing, queries, simhash


def plain_best_fit(items, capacity):
    """Every bin is tried for every item."""
    room, sources, clusters, out = [], [], [], []
    for size, source, cluster in items:
        fits = [i for i, r in enumerate(room) if r >= size and source not in sources[i] and cluster not in clusters[i]]
        best = min((room[i] for i in fits), default=None)
        out.append(best)
        if best is None:
            room.append(capacity)
            sources.append(set())
            clusters.append(set())
            b = len(room) - 1
        else:
            b = next(i for i in fits if room[i] == best)
        room[b] -= size
        if source is not None:
            sources[b].add(source)
        clusters[b].add(cluster)
    return out, len(room)


def test_each_item_goes_to_the_tightest_compatible_bin():
    rng = random.Random(5)
    for _ in range(30):
        items = sorted(((rng.randint(1, 40), rng.choice([None, 0, 1, 2, 3, 4]), rng.randint(0, 30)) for _ in range(120)), reverse=True, key=lambda i: i[0])
        bins, places = packing.best_fit(items, 64)
        room, inside = defaultdict(lambda: 64), defaultdict(list)
        got = []
        for b, item in zip(bins, items, strict=True):
            fits = [r for k, r in room.items() if r >= item[0] and all((x[1] is None or x[1] != item[1]) and x[2] != item[2] for x in inside[k])]
            got.append((room[b] if b in inside else None, min(fits, default=None)))
            room[b] -= item[0]
            inside[b].append(item)
        assert all(a == b for a, b in got)
        assert all(r >= 0 for r in room.values())
        assert all(places.count(p) <= len(set(bins)) for p in set(places))


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin string")
    out = packing.pack(docs, **options)
    words, bins = defaultdict(int), defaultdict(list)
    for r in out.collect():
        words[r.doc_id] += r.n_words
        if r.bin is None:
            assert r.n_words == 0
        else:
            bins[r.bin].append(r)
    return docs, out, words, bins


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)) + (f" t{i}" if i % 3 else ""), rng.choice(["hot", "hot", "a", "b", None]), "clash") for i in range(600)]
    docs, out, words, bins = check(spark, rows, capacity=32, group_words=2000)
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    assert all(words[i] == len(text[i].split()) for i in text)
    for found in bins.values():
        assert sum(r.n_words for r in found) == found[0].bin_words <= 32
        assert sorted(r.place for r in found) == list(range(len(found)))
        named = [source[r.doc_id] for r in found if source[r.doc_id] is not None]
        assert len(named) == len(set(named)) and len({text[r.doc_id] for r in found}) == len(found)
    assert sorted(map(str, out.collect())) == sorted(map(str, packing.pack(docs, capacity=32, group_words=2000).collect()))


def test_cases(spark):
    rows = [(None, None, None, "x"), (1, "a b", None, "x"), (1, "a b", None, "x"), (2, "", "s", "x"), (3, "w " * 10, "s", "x")]
    _, out, words, bins = check(spark, rows, capacity=4)
    assert out.count() == 1 + 2 + 1 + 3 and words[1] == 4 and words[3] == 10
    assert all(len({r.doc_id for r in b}) == len(b) for b in bins.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin string")
    assert packing.pack(docs.limit(0)).count() == 0
    named = packing.pack(docs.withColumn("c", F.lit(7)), capacity=4, cluster=F.col("c")).where("bin is not null").groupBy("bin").count()
    assert all(r["count"] == 1 for r in named.collect())


def test_near_copies_share_no_bin(spark, tmp_path):
    """The registered query parts what op3 finds near, though its texts are not equal and have no source."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
    near = [" ".join(base), " ".join(base).upper(), "  ".join(base) + "\n", *(" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (0, 60, 199))]
    far = [" ".join(f"v{rng.randint(0, 9999)}" for _ in range(150)) for _ in range(12)]
    rows = [(i, t, None) for i, t in enumerate(near + far)] + [(None, near[0], None), (0, far[0], None), (90, "", None), (91, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    component = defaultdict(set)
    for r in simhash.near_duplicates(docs.where("doc_id < 18")).collect():
        component[r.component_id].add(r.doc_id)
    assert set(range(len(near))) <= max(component.values(), key=len)
    out = queries.queries()["op4_best_fit_packing"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.n_words) for r in out) == sorted((d or -1, len((t or "").split())) for d, t, _ in rows)
    bins = [r.bin for r in out if r.n_words == 200]
    assert len(bins) == len(near) + 1 and len(set(bins)) == len(bins)
    assert any(len({r.doc_id for r in out if r.bin == b}) > 1 for b in bins)
