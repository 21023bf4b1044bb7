import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regionloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), n < 50 or 100 * len(covered) > 50 * n


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
CASES = [None, "", " \n\t", "a", "a a a", "a a a a", "a b a b a", "a b c a b c", "x\x0by\x0cz\r\nx", "é ü #*$  ", "a\na\n \n\na", "one two three four " * 30, "w" * 300_000, " ".join(f"w{i}" for i in range(60)), " ".join(str(i % 7) for i in range(30_000))]


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, m string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in quality.judge(df).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]
    return df


def test_counts(spark):
    df = check(spark, CASES)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    good = {r.doc_id for r in quality.judge(df).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good
    assert quality.judge(df.limit(0)).count() == 0
    assert quality.judge(df.unionByName(df)).count() == 2 * len(CASES)


def test_random_texts(spark):
    texts = []

    @given(st.lists(st.lists(st.sampled_from(["a", "b", "cc", "#", "ä"]), max_size=25).map(" ".join), max_size=6).map("\n".join))
    @settings(max_examples=150, deadline=None)
    def gather(t):
        texts.append(t)

    gather()
    check(spark, texts)


def test_rules_bound_each_ratio(spark):
    good = ("the cat and the dog went to a house that was as old as it is " * 1 + " ".join(f"word{i}" for i in range(60)) + "\n") + "the end of it"
    bad = {"symbols": good.replace("word", "#*#word"), "stop": " ".join(f"zzword{i}" for i in range(80)), "long": " ".join("q" * 40 + str(i) for i in range(80)), "lines": good + "".join(f"\nthe a\nthe a\nb{i}" for i in range(0)) + "\nthe same line of it" * 3}
    df = spark.createDataFrame([("good", good), *bad.items()], "doc_id string, text string")
    kept = {r.doc_id for r in quality.judge(df).where("kept").collect()}
    assert "good" in kept and not kept & {"symbols", "stop", "long"}
    strict = [("lines", "n_dup_lines", "n_lines", None, 0.1)]
    assert {r.doc_id for r in quality.judge(df, strict).where("not kept and not base_failed").collect()} == {"lines"}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality.judge(df.withColumn("x", F.lit(1))).count() == 1
