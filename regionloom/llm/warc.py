"""WARC records: reading, and resolving revisits that were not modified.

A revisit names no payload of its own: the archive answered a conditional
request.  It is joined as-of to the latest earlier full response of its
canonical URL, and stands if the validators agree: the entity tag if both
records have one (weakly compared), else the last-modified date, else the
payload digest.  The resolved record is the response with the headers that a
304 may replace (``PERMITTED``) taken from the revisit.

A revisit whose profile says that the payload was found identical by its digest
answers with headers of its own, like a full response: it stands if the digests
agree, whatever the other validators say, and keeps its own headers.

The as-of join runs in three levels, so that one URL with a third of all records
is not one task: the records of a second become one row, combined before the
shuffle; within a time bucket a window runs over its seconds, of which a day has
86,400 at most; over buckets a window runs over one row for each.  Revisits find
their answer by URL and second.  Payloads stay where they are; the result names
the response by its record_id.

Defined cases: a revisit without an earlier response is ``orphan``; without a
validator that both records have, ``unverified``; with unequal ones,
``mismatch``; a response at the same second is not earlier; of several at the
latest second the greatest record_id counts; null URLs match nothing; a null
time is never earlier; repeated rows are each resolved; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import task_store

#: Header fields that a 304 may bring up to date (RFC 9110 and 9111; fixed values).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query fields that only track where a visitor came from.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
BUCKET_SECONDS = 86_400

SCHEMA = "record_id string, url string, ts bigint, kind string, etag string, last_modified string, digest string, headers map<string,string>, profile string, payload binary"


def canonical(url: Column) -> Column:
    """A URL without scheme, fragment, www, default port and tracking fields, host in lower case, query fields sorted."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.|:(80|443)$", "")
    path = F.regexp_extract(bare, "^[^/?]*(/[^?]*)?", 1)
    fields = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(fields, lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(host, F.when(path == "", "/").otherwise(path), query)


def _tag(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """A row for each revisit of ``records``: record_id, key, ts, status, response_id, headers.

    ``records`` has record_id, url, ts (seconds), kind ('response' or 'revisit'),
    etag, last_modified, digest, headers (map with lower-case names), and may have
    profile, the revisit's WARC-Profile.
    """
    profile = F.lower(F.coalesce(F.col("profile").cast("string"), F.lit(""))) if "profile" in records.columns else F.lit("")
    r = records.select("record_id", canonical(F.col("url")).alias("key"), F.col("ts").cast("long").alias("ts"), "kind", "etag", "last_modified", "digest", F.array_sort(F.map_entries("headers")).alias("headers"), profile.contains("identical-payload-digest").alias("identical"))
    r = r.where(F.col("kind").isin("response", "revisit"))
    dated = F.col("key").isNotNull() & F.col("ts").isNotNull()
    response = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"))
    # one row for each second of a URL
    seconds = r.where(dated).groupBy("key", "ts").agg(F.max(response).alias("own"), F.max(F.col("kind") == "revisit").alias("asked")).withColumn("bucket", F.floor(F.col("ts") / bucket_seconds))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    near = F.max("own").over(upto(Window.partitionBy("key", "bucket").orderBy("ts")))
    # what earlier buckets end with: a row for each bucket of a URL
    ends = seconds.groupBy("key", "bucket").agg(F.max("own").alias("end"))
    ends = ends.select("key", "bucket", F.max("end").over(upto(Window.partitionBy("key").orderBy("bucket"))).alias("far"))
    answers = seconds.withColumn("near", near).where("asked").join(ends, ["key", "bucket"]).select("key", "ts", F.coalesce("near", "far").alias("found"))
    revisits = r.where("kind = 'revisit'")
    found = revisits.where(dated).join(answers, ["key", "ts"])
    lost = revisits.where(~dated).withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    found = found.unionByName(lost.select(found.columns))
    both = lambda c: F.col(c).isNotNull() & F.col(f"found.{c}").isNotNull()
    verdict = lambda same: F.when(same, "resolved").otherwise("mismatch")
    status = (
        F.when(F.col("found").isNull(), "orphan")
        .when(F.col("identical"), F.when(both("digest"), verdict(F.col("digest") == F.col("found.digest"))).otherwise("unverified"))
        .when(both("etag"), verdict(_tag(F.col("etag")) == _tag(F.col("found.etag"))))
        .when(both("last_modified"), verdict(F.col("last_modified") == F.col("found.last_modified")))
        .when(both("digest"), verdict(F.col("digest") == F.col("found.digest")))
        .otherwise("unverified")
    )
    found = found.withColumn("status", status)
    fresh = F.filter("headers", lambda h: h["key"].isin(*PERMITTED))
    names = F.transform(fresh, lambda h: h["key"])
    old = F.filter("found.headers", lambda h: ~F.array_contains(names, h["key"]))
    merged = F.when((F.col("status") == "resolved") & F.col("identical"), F.coalesce("headers", F.array().cast(r.schema["headers"].dataType))).when(F.col("status") == "resolved", F.array_sort(F.concat(F.coalesce(old, F.array().cast(r.schema["headers"].dataType)), F.coalesce(fresh, F.array().cast(r.schema["headers"].dataType)))))
    return found.select("record_id", "key", "ts", "status", F.when(F.col("status") == "resolved", F.col("found.record_id")).alias("response_id"), F.map_from_entries(merged).alias("headers"))


#: Bytes that are read at once, and of a head of fields at most.
_READ = 1 << 20
_HEAD = 1 << 20


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of WARC files (plain or gzipped) below ``path``.

    A file is a task and is read as a stream: a task holds the record that it is at, never a file.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                store, there = task_store(name)
                with store.open_input_stream(there, compression=None) as f:
                    for row in parse_warc(iter(lambda: f.read(_READ), b"")):
                        yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.repartition(max(1, len(files._jdf.inputFiles())), "path").mapInArrow(records, SCHEMA)


_ARROW = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("ts", pa.int64()), ("kind", pa.string()), ("etag", pa.string()), ("last_modified", pa.string()), ("digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("profile", pa.string()), ("payload", pa.binary())])


def _fields(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a file, gzip members taken apart one after another; a truncated or damaged one ends them."""
    first = next(pieces, b"")
    if first[:2] != b"\x1f\x8b":
        yield first
        yield from pieces
        return
    inflate, data = zlib.decompressobj(31), first
    try:
        while data or (data := next(pieces, b"")):
            if out := inflate.decompress(data, _READ):
                yield out
            data = inflate.unconsumed_tail
            if inflate.eof:
                # the next member, if no padding follows
                data = inflate.unused_data or next(pieces, b"")
                while data and not (data := data.lstrip(b"\0")):
                    data = next(pieces, b"")
                inflate = zlib.decompressobj(31)
    except zlib.error:
        return


class _Reader:
    """Exact reads over a stream of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def more(self) -> bool:
        for piece in self.pieces:
            if piece:
                self.held += piece
                return True
        return False

    def until(self, mark: bytes, most: int) -> bytes | None:
        """What comes before ``mark``, which is passed over; None at the end, or if it is not found within ``most`` bytes."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if seen > most or not self.more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes | None:
        """The next ``n`` bytes; None if fewer are left."""
        while len(self.held) < n:
            if not self.more():
                return None
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> bool:
        """Passes over ``n`` bytes without holding them."""
        while n > len(self.held):
            n -= len(self.held)
            self.held.clear()
            if not self.more():
                return False
        del self.held[:n]
        return True

    def to(self, mark: bytes) -> bool:
        """Drops what comes before ``mark``, which stays."""
        while (at := self.held.find(mark)) < 0:
            del self.held[: max(0, len(self.held) - len(mark) + 1)]
            if not self.more():
                return False
        del self.held[:at]
        return True


def parse_warc(data: bytes | Iterator[bytes]) -> Iterator[dict]:
    """The response and revisit records of one file; others are passed over, a damaged or truncated end stops the file."""
    from datetime import datetime

    reader = _Reader(_inflated(iter([data]) if isinstance(data, (bytes, bytearray)) else data))
    while reader.to(b"WARC/"):
        if (head := reader.until(b"\r\n\r\n", _HEAD)) is None:
            if not reader.skip(5):  # no record begins here
                return
            continue
        fields = _fields(head)
        if not fields.get("content-length", "").isdigit():
            continue
        length, kind = int(fields["content-length"]), fields.get("warc-type")
        if kind not in ("response", "revisit"):
            if not reader.skip(length):
                return
            continue
        if (block := reader.take(length)) is None:
            return
        head, _, body = block.partition(b"\r\n\r\n")
        http = _fields(head)
        try:
            ts = int(datetime.fromisoformat(fields["warc-date"].replace("Z", "+00:00")).timestamp())
        except (KeyError, ValueError):
            ts = None
        yield {"record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "ts": ts, "kind": kind, "etag": http.get("etag"), "last_modified": http.get("last-modified"), "digest": fields.get("warc-payload-digest"), "headers": http, "profile": fields.get("warc-profile"), "payload": body if kind == "response" else None}


#: The captures that the query makes of ``pages``: every page is fetched once, and asked for again twice.
CAPTURES = """
SELECT page_id * 4 AS record_id, url, page_id * 1000 AS ts, 'response' AS kind, '"' || substr(md5(html), 1, 16) || '"' AS etag,
       CASE WHEN page_id % 3 = 0 THEN 'day ' || cast(page_id AS STRING) END AS last_modified, md5(html) AS digest, page_id AS page
FROM pages
UNION ALL
SELECT page_id * 4 + 1, 'HTTPS://' || regexp_replace(url, '^[a-z]+://', '') || CASE WHEN url LIKE '%#%' THEN '' ELSE '#again' END, page_id * 1000 + 500 + page_id % 7 * 40000, 'revisit',
       CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"stale"' ELSE 'W/"' || substr(md5(html), 1, 16) || '"' END,
       CASE WHEN page_id % 11 = 0 THEN 'day 0' ELSE 'day ' || cast(page_id AS STRING) END, CASE WHEN page_id % 2 = 0 THEN md5(html) END, page_id
FROM pages
UNION ALL
SELECT page_id * 4 + 2, url, page_id * 1000 - CASE WHEN page_id % 13 = 0 THEN 5 ELSE -900000 END, 'revisit', CAST(NULL AS STRING), CAST(NULL AS STRING),
       CASE WHEN page_id % 4 = 0 THEN md5(html) WHEN page_id % 4 = 1 THEN 'other' END, page_id
FROM pages
"""


def captures(pages: DataFrame) -> DataFrame:
    """Records over ``pages`` as an archive would hold them: full responses and two later not-modified answers to each."""
    sql = CAPTURES.replace("FROM pages", "FROM {pages}")
    made = pages.sparkSession.sql(sql, pages=pages.select("page_id", "url", "html"))
    date = F.concat(F.lit("t"), F.col("ts").cast("string"))
    headers = F.map_filter(F.create_map(F.lit("etag"), F.col("etag"), F.lit("last-modified"), F.col("last_modified"), F.lit("date"), date, F.lit("content-type"), F.when(F.col("kind") == "response", "text/html").otherwise("message/http"), F.lit("content-length"), F.when(F.col("kind") == "response", "1").otherwise("0")), lambda k, v: v.isNotNull())
    return made.withColumn("headers", headers)


def query(pages: DataFrame) -> DataFrame:
    r = resolve(captures(pages))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda h: F.concat(h["key"], F.lit(": "), h["value"]))
    return r.select("record_id", "key", "ts", "status", "response_id", F.array_join(lines, "; ").alias("merged_headers"))


ORACLE_SQL = r"""
WITH c AS (""" + CAPTURES + r"""),
p AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z][a-z0-9+.-]*://', '', 'i') AS bare FROM c),
f AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.|:(80|443)$', '') AS host,
         regexp_extract(bare, '^[^/?]*(/[^?]*)?', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS fields
  FROM p),
r AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END AS key FROM f),
m AS (
  SELECT v.*, max(struct_pack(ts := o.ts, record_id := o.record_id, etag := o.etag, last_modified := o.last_modified, digest := o.digest)) AS found
  FROM r v LEFT JOIN r o ON o.kind = 'response' AND o.key = v.key AND o.ts < v.ts
  WHERE v.kind = 'revisit' GROUP BY ALL),
s AS (
  SELECT *, CASE WHEN found IS NULL OR found.record_id IS NULL THEN 'orphan'
    WHEN etag IS NOT NULL AND found.etag IS NOT NULL THEN CASE WHEN replace(etag, 'W/', '') = found.etag THEN 'resolved' ELSE 'mismatch' END
    WHEN last_modified IS NOT NULL AND found.last_modified IS NOT NULL THEN CASE WHEN last_modified = found.last_modified THEN 'resolved' ELSE 'mismatch' END
    WHEN digest IS NOT NULL AND found.digest IS NOT NULL THEN CASE WHEN digest = found.digest THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unverified' END AS status
  FROM m)
SELECT record_id, key, ts, status, CASE WHEN status = 'resolved' THEN found.record_id END AS response_id,
       CASE WHEN status = 'resolved' THEN 'content-length: 1; content-type: text/html; date: t' || ts::VARCHAR || '; etag: ' || coalesce(etag, found.etag) ||
         coalesce('; last-modified: ' || coalesce(last_modified, found.last_modified), '') END AS merged_headers
FROM s
"""
