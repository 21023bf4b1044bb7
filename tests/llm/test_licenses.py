import re

import pytest
from pyspark.sql import functions as F

from regionloom.llm import licenses

BASE = [(i, "\n".join(f"plain words number {i} {j} about cats and houses" for j in range(6)), "clash") for i in range(200)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*BASE, (900, "first line\nLicensed under the Apache License, Version 2.0.\nlast", "x"), (901, "Released under the MIT License.", "x"), (901, "Released under the MIT License.", "x"), (902, "# This work is licensed under the GNU General Public License, version 3.", "x"), (903, "We released the license plate under the table", "x"), (904, None, "x"), (905, "", "x"), (None, "Licensed under CC BY-NC 4.0.", "x"), (906, "word " * 20000 + "\nLicensed under CC BY-SA 4.0.", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, family string")


def test_families(docs):
    got = sorted((str(r.doc_id), r.paragraph, r.family) for r in licenses.scan(docs).where("confirmed").collect())
    assert got == [("900", 1, "apache-2.0"), ("901", 0, "mit"), ("901", 0, "mit"), ("902", 0, "gpl"), ("906", 1, "cc-by-sa"), ("None", 0, "cc-by-nc")]


def test_every_notice_is_its_family(spark):
    rows = [(k, family, text) for k, (family, texts) in enumerate(licenses.NOTICES.items()) for text in texts]
    docs = spark.createDataFrame([(k, t) for k, _, t in rows] + [(1000 + i, t) for i, t, _ in BASE], "doc_id long, text string")
    found = {r.text: r.family for r in licenses.scan(docs).where("confirmed and doc_id < 1000").collect()}
    assert found == {t: f for _, f, t in rows}


def test_anchors_lose_nothing(docs):
    """Scoring every paragraph with the model, in Python, finds no licence that the scan leaves out."""
    import numpy as np

    model, _ = licenses.train(docs)
    place = {f: i for i, f in enumerate(model.features)}
    want = set()
    for r in docs.where("text is not null").collect():
        for n, line in enumerate(r.text.split("\n")):
            z = model.bias + sum((model.weights[place[f]] for f in licenses._features(licenses._tokens(line)) if f in place), np.zeros(len(model.bias)))
            if z.argmax():
                want.add((r.doc_id, n, licenses.FAMILIES[z.argmax()]))
    assert {(r.doc_id, r.paragraph, r.family) for r in licenses.scan(docs).collect()} == want


def test_tokens_agree(spark):
    texts = ["a.b, (C) -d- e/f 'x'", "", "É — ü.", "1.0. v2"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(licenses.tokens(F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == [licenses._tokens(t) for t in texts]
    assert re.fullmatch(r"\d", "1")


def test_empty_and_native(spark, docs):
    assert licenses.scan(docs.limit(0)).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_notices_with_words_beside_them_and_wrapped(spark):
    permission = licenses.NOTICES["mit"][3].split()
    wrapped = "\n".join("# " + " ".join(permission[i : i + 8]) for i in range(0, len(permission), 8))
    texts = {
        1: "Foobar is licensed under the Apache License, Version 2.0.",
        2: "This software is released under the MIT License.",
        3: "intro words\n\n" + wrapped + "\n\nother words",
        4: "Some parts that we wrote here were released under\n\nthe MIT License.",  # a blank line parts them
    }
    docs = spark.createDataFrame([*texts.items(), *[(1000 + i, t) for i, t, _ in BASE]], "doc_id long, text string")
    rows = licenses.scan(docs).collect()
    found = {(r.doc_id, r.family) for r in rows if r.confirmed}
    assert found == {(1, "apache-2.0"), (2, "mit"), (3, "mit")}
    assert all(r.text == texts[r.doc_id].split("\n")[r.paragraph] for r in rows if r.doc_id in texts)


def test_block_ends_at_blank_lines(spark):
    text = "a\n \nb\nc\nd\n\ne"
    got = spark.createDataFrame([(text.split("\n"),)], "lines array<string>").select(F.transform("lines", lambda x, i: licenses._block(F.col("lines"), i)).alias("b")).first().b
    assert [b.split() for line, b in zip(text.split("\n"), got, strict=True) if line.strip()] == [["a"], ["b", "c", "d"], ["b", "c", "d"], ["b", "c", "d"], ["e"]]
