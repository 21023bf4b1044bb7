import corpus_pipeline
from regionloom.llm import packing, quality, simhash, toxicity


def test_stages_follow_one_another(spark, tmp_path):
    docs = [(i, f"the start of document {i} and " + " ".join(f"w{i}x{j}" for j in range(60)), "en", f"s{i % 3}", 1) for i in range(300)]
    docs += [(400 + i, docs[0][1], "en", "s0", 1) for i in range(5)] + [(500, "too short", "en", "s1", 1), (501, None, None, None, None)]
    bad = [(600 + i, docs[i][1] + " vileword", "en", "s2", 1) for i in range(90)]
    sf = str(tmp_path)
    spark.createDataFrame(docs + bad, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(d[0], 1, 0) for d in docs] + [(d[0], 1, 1) for d in bad], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        now.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        kept[name] = now
        if name != "packing":
            assert now.columns == columns
    of = lambda n: {r.doc_id for r in kept[n].select("doc_id").collect()}
    assert not of("toxicity") & {d[0] for d in bad} and of("toxicity") >= {d[0] for d in docs}
    assert of("quality_rules") == set(range(300)) | set(range(400, 405))
    assert of("simhash_near_dedup") == set(range(300))
    words = {d[0]: len(d[1].split()) for d in docs if d[1]}
    packed = {}
    for r in kept["packing"].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_words
    copies = {r.doc_id: r["count"] for r in kept["mixing"].groupBy("doc_id").count().collect()}
    assert packed == {d: words[d] * n for d, n in copies.items()} and max(copies.values()) <= 2
    again = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in kept["packing"].collect())


def test_stages_are_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and all((toxicity.keep_clean, quality.keep_good, simhash.keep_one, packing.pack))
