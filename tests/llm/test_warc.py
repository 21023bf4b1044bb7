import gzip
import random

from pyspark.sql import functions as F

from regionloom.llm import warc

RECORD = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, status string"


def test_canonical(spark):
    urls = {"HTTP://www.Example.com:80/a?b=2&utm_source=x&a=1#t": "example.com/a?a=1&b=2", "https://example.com": "example.com/", "http://e.org/?ref=q": "e.org/", "e.org/x?": "e.org/x", "https://E.org:443/A%20b": "e.org/A%20b", "http://e.org?b&a": "e.org/?a&b"}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.canonical(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in rows} == urls


def plain(rows):
    out = {}
    for v in rows:
        if v[3] != "revisit":
            continue
        earlier = [r for r in rows if r[3] == "response" and r[1] is not None and r[1] == v[1] and r[2] is not None and v[2] is not None and r[2] < v[2]]
        if not earlier:
            out[v[0]] = ("orphan", None, None)
            continue
        f = max(earlier, key=lambda r: (r[2], r[0]))
        status = "unverified"
        for k in (4, 5, 6):
            if v[k] is not None and f[k] is not None:
                a, b = (x.removeprefix("W/") if k == 4 else x for x in (v[k], f[k]))
                status = "resolved" if a == b else "mismatch"
                break
        merged = {**f[7], **{k: x for k, x in v[7].items() if k in warc.PERMITTED}} if status == "resolved" else None
        out[v[0]] = (status, f[0] if status == "resolved" else None, merged)
    return out


def test_against_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        kind = rng.choice(["response", "revisit", "revisit"])
        url = rng.choice(["hot.org/", "hot.org/", "a.org/x", "b.org/", None])
        rows.append((i, url, rng.choice([rng.randrange(400), None]) if i % 9 == 0 else rng.randrange(400), kind, rng.choice([None, '"1"', 'W/"1"', '"2"']), rng.choice([None, "m1", "m2"]), rng.choice([None, "d1", "d2"]), {"date": str(i), "content-length": str(i), **({"vary": "v"} if i % 2 else {})}, "clash"))
    for bucket in (7, 100, 10_000):
        got = {r.record_id: (r.status, r.response_id, r.headers) for r in warc.resolve(spark.createDataFrame(rows, RECORD), bucket).collect()}
        assert got == plain(rows)
    assert warc.resolve(spark.createDataFrame([], RECORD)).count() == 0
    twice = [rows[i] for i in range(20) for _ in range(2)]
    assert warc.resolve(spark.createDataFrame(twice, RECORD)).count() == 2 * sum(r[3] == "revisit" for r in rows[:20])


def record(kind, url, date, head, body=b""):
    http = head + b"\r\n\r\n" + body
    lines = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Target-URI: " + url, b"WARC-Date: " + date, b"WARC-Record-ID: <urn:" + date + b">", b"Content-Length: " + str(len(http)).encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + http + b"\r\n\r\n"


def test_reading(spark, tmp_path):
    data = record(b"warcinfo", b"", b"2020-01-01T00:00:00Z", b"x") + record(b"response", b"http://a.org/", b"2020-01-01T00:00:01Z", b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\nX: y", b"body\r\n\r\nmore") + record(b"revisit", b"http://a.org/", b"2020-01-02T00:00:00Z", b'HTTP/1.1 304 Not Modified\r\nETag: W/"1"\r\nDate: now')
    (tmp_path / "a.warc").write_bytes(data + b"WARC/1.1\r\nbroken")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data[:200]) + gzip.compress(data[200:]))
    rows = warc.read_warc(spark, str(tmp_path))
    assert rows.count() == 4
    one = rows.where("kind = 'response'").first()
    assert one.payload == b"body\r\n\r\nmore" and one.ts == 1577836801 and one.etag == '"1"'
    done = warc.resolve(rows).collect()
    assert {r.status for r in done} == {"resolved"} and done[0].headers["x"] == "y" and done[0].headers["date"] == "now"
