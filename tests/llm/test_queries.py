import os

import pytest

from regionloom.llm import embeddings, queries

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "labels"]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def connected(**tables):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM {tables.get(t) or repr(SF + '/' + t + '.parquet')}")
    return db


def rows(r, at):
    return sorted((tuple(x[i] for i in at) for x in r), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_those_of_sql(spark, name):
    want, got = connected().sql(queries.oracle_sql()[name]), queries.queries()[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got.collect(), range(len(got.columns))) == rows(want.fetchall(), [want.columns.index(c) for c in got.columns])


@needs_data
def test_links_equal_those_of_sql(spark, tmp_path):
    """The plain tables hold no close vectors: some are made here."""
    base = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").limit(60).collect()]
    made = [(i, v, i % 2) for i, v in enumerate(base)] + [(100 + i, [x + 0.01 * ((j * 7 + i) % 5) for j, x in enumerate(v)], i % 2) for i, v in enumerate(base[:40])] + [(200 + i, v, 0) for i, v in enumerate(base[:9])] + [(300, None, 1), (301, [0.0] * 64, 1)]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").write.parquet(path)
    want = connected(embeddings=repr(path + "/*.parquet")).sql(embeddings.ORACLE_SQL)
    got = embeddings.near_duplicates(spark.read.parquet(path))
    assert rows(got.collect(), range(4)) == rows(want.fetchall(), [want.columns.index(c) for c in got.columns])
    assert got.where("n_links > 0").count() > 20


@needs_data
def test_latest_of_many_responses_equals_that_of_sql(spark, tmp_path):
    """The plain pages have one response a URL: here many share one, and a third of them a hot one."""
    urls = [f"http://www.a.org/{i % 25}?b=1&a={i % 2}" if i % 3 else "https://hot.org/x#y" for i in range(400)]
    made = [(i, u, f"<p>{i % 40}</p>") for i, u in enumerate(urls)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(made, "page_id long, url string, html string").write.parquet(path)
    want = connected(pages=repr(path + "/*.parquet")).sql(queries.oracle_sql()["op7_warc_revisits"])
    got = queries.queries()["op7_warc_revisits"](spark, str(tmp_path))
    found = got.collect()
    assert rows(found, range(len(got.columns))) == rows(want.fetchall(), [want.columns.index(c) for c in got.columns])
    assert len(found) == 800 and sum(r.status == "resolved" for r in found) > 20
    # the latest response is mostly not that of the revisit's own page
    assert sum(r.response_id is not None and r.response_id // 4 != r.record_id // 4 for r in found) > 20


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
