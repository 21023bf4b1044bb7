import random
import zlib

import numpy as np
import pytest

from regionloom.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    syllables = ["ka", "lo", "mi", "tu", "re", "sa", "no", "vi"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    docs, labels = [], []
    for i in range(1500):
        words = [word() for _ in range(rng.randint(20, 80))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["badword", "Nastything!", "grrrr" + word()]))
        docs.append((i, " ".join(words), "clash"))
        if rng.random() < 0.7:
            labels.append((i, 1, int(toxic)))
        docs[-1] = (*docs[-1], int(toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, score string, truth int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, corpus):
    docs, labels = corpus
    out = toxicity.score(docs.drop("truth"), labels)
    rows = out.join(docs.select("doc_id", "truth"), "doc_id").collect()
    assert len(rows) == 1500
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    hit = sum(r.predicted for r in held if r.truth) / sum(r.truth for r in held)
    false = sum(r.predicted for r in held if not r.truth) / sum(1 - r.truth for r in held)
    assert hit > 0.9 and false < 0.02
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_held_out_labels_change_nothing(spark, corpus):
    docs, labels = corpus
    fold = toxicity.fold(labels["doc_id"])
    assert toxicity.train(docs, labels) == toxicity.train(docs, labels.where(fold != 0))


def test_risk_is_corrected_by_the_prior():
    rng = np.random.default_rng(0)
    row = lambda p: np.flatnonzero(rng.random(3) < p)
    positive = [row([0.9, 0.1, 0.5]) for _ in range(400)]
    unlabelled = [row([0.9, 0.1, 0.5]) for _ in range(200)] + [row([0.02, 0.6, 0.5]) for _ in range(1800)]
    w, b = toxicity.fit_nnpu(positive, unlabelled, 3, 0.1)
    assert w[0] > 2 and w[1] < 0 and abs(w[2]) < 1 and b < 0


def test_cases(spark, corpus):
    _, labels = corpus
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "badword " * 3)], "doc_id long, text string")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [True]
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert all(r.predicted == 0 for r in toxicity.score(docs, labels.limit(0)).collect())
