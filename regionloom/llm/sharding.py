"""Sharding by extendible hashing.

A directory maps hash-prefix bits to buckets.  A bucket that is over the byte
limit, and only such a bucket, splits on the next bit, until every bucket fits.
The tree is derived from one histogram of prefixes: a prefix is a bucket if it
fits and its parent does not.  Buckets that are still too large at the
histogram's depth get a finer histogram of their own rows in the next round.

Defined cases: a null text has 0 bytes; a null doc_id is a key like any other;
rows are spread by doc_id and text, so that a repeated doc_id does not stay
together; rows equal in both share all 60 bits, and their last bucket is dealt
by running bytes; a single row over the limit is a bucket of its own and has
``oversized`` set; an empty table gives no rows.  Extra columns are kept by
``write_shards`` and not read by ``assign_shards``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS = 60
LIMIT = 64 << 20


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of an MD5, as other engines can compute it too."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: int | Column) -> Column:
    return F.expr(f"shiftright(h, {BITS} - {depth})")


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """The directory of ``rows`` (h, bytes), in rounds of (depth of its entries, table).

    The table has entry, depth, prefix, shard_bytes, shard_rows: the bucket that
    the entry points to.  An entry of null depth is refined in the next round.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    at, deep = 0, min(BITS, max(4, math.ceil(math.log2(max(total / limit, 1))) + 4))
    left, rounds = rows, []
    while True:
        histogram = written(left.groupBy(_prefix(deep).alias("entry")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")), "histogram")
        chain = histogram.withColumn("depth", F.explode(F.sequence(F.lit(at), F.lit(deep)))).withColumn("prefix", F.expr(f"shiftright(entry, {deep} - depth)"))
        sums = chain.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS))
        # sums only fall with depth: the shallowest prefix that fits is the one whose parent had to split
        bucket = chain.join(fits, ["depth", "prefix"]).groupBy("entry").agg(F.min_by(F.struct("depth", "prefix", "shard_bytes", "shard_rows"), "depth").alias("bucket"))
        entries = written(histogram.select("entry").join(bucket, "entry", "left").select("entry", "bucket.*"), "directory")
        rounds.append((deep, entries))
        over = entries.where(F.col("depth").isNull()).select("entry")
        if deep == BITS or over.isEmpty():
            return rounds
        left = written(left.withColumn("entry", _prefix(deep)).join(over, "entry", "left_semi").select("h", "bytes"), "oversized")
        at, deep = deep, min(BITS, deep + 8)


def _placed(rows: DataFrame, rounds: list[tuple[int, DataFrame]], limit: int) -> DataFrame:
    """``rows`` (h, bytes and others) with shard, depth, shard_bytes, oversized."""
    left, parts, columns = rows, [], rows.columns
    for k, (deep, entries) in enumerate(rounds):
        found = left.withColumn("entry", _prefix(deep)).join(entries, "entry", "left")
        parts.append(found.where(F.col("depth").isNotNull()).drop("entry") if k + 1 < len(rounds) else found.drop("entry"))
        left = found.where(F.col("depth").isNull()).select(columns)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    out = out.withColumn("shard", F.concat_ws(":", F.col("depth").cast("string"), F.col("prefix").cast("string")))
    if rounds[-1][0] == BITS:
        whole = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
        out = out.where(whole).unionByName(_dealt(out.where(~whole), limit))
    return out.withColumn("oversized", F.col("shard_bytes") > limit).drop("prefix", "shard_rows")


def _dealt(equal: DataFrame, limit: int) -> DataFrame:
    """Rows equal in all bits, dealt by number: as many to a part as fit whatever their order.

    They are numbered in the files of a written table, each file by itself, with a count of what is before it:
    no set of equal rows is one task.
    """
    table = written(equal, "equal-rows")
    rows = table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    sums = rows.groupBy("h", "_file").agg(F.count("*").alias("_n"), F.max("bytes").alias("_most"))
    of = Window.partitionBy("h")
    each = F.greatest(F.floor(F.lit(limit) / F.greatest(F.max("_most").over(of), F.lit(1))), F.lit(1))
    before = F.coalesce(F.sum("_n").over(of.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("h", "_file", each.alias("_each"), before.alias("_before"))
    number = F.row_number().over(Window.partitionBy("h", "_file").orderBy("_at")) - 1
    dealt = rows.withColumn("_number", number).join(sums, ["h", "_file"]).withColumn("part", F.floor((F.col("_number") + F.col("_before")) / F.col("_each")))
    held = dealt.groupBy("h", "part").agg(F.sum("bytes").alias("_held"))
    named = dealt.join(held, ["h", "part"]).withColumn("shard", F.concat_ws(":", "shard", F.col("part").cast("string"))).withColumn("shard_bytes", F.col("_held"))
    return named.select(equal.columns)


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))


def assign_shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, bytes, shard, depth, shard_bytes, oversized.

    ``shard`` names the bucket as depth:prefix (and :part where equal rows had to be dealt).
    """
    rows = written(_keyed(docs, "doc_id"), "rows")
    return _placed(rows, directory(rows, limit), limit).select("doc_id", "bytes", "shard", "depth", "shard_bytes", "oversized")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes ``docs`` with all its columns below ``path``, one folder ``_shard=...`` for each bucket."""
    rounds = directory(written(_keyed(docs), "rows"), limit)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    placed = _placed(docs.select(row, "doc_id", "text").transform(lambda d: _keyed(d, "row")), rounds, limit)
    placed.select("row.*", F.col("shard").alias("_shard")).repartition("_shard").write.partitionBy("_shard").parquet(path)


#: The query's limit: small, so that buckets split on tables of a few megabytes too.
QUERY_LIMIT = 256 << 10

ORACLE_SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
d(depth) AS (SELECT 0 UNION ALL SELECT depth + 1 FROM d WHERE depth < 30),
s AS (SELECT depth, h >> ({BITS} - depth) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS n FROM r, d GROUP BY ALL),
leaf AS (
  SELECT r.doc_id, r.bytes, r.h, min(s.depth) AS depth
  FROM r JOIN s ON s.prefix = r.h >> ({BITS} - s.depth) AND (s.shard_bytes <= {QUERY_LIMIT} OR s.n = 1)
  GROUP BY ALL)
SELECT leaf.doc_id, leaf.bytes, leaf.depth::VARCHAR || ':' || s.prefix::VARCHAR AS shard,
       leaf.depth::INT AS depth, s.shard_bytes, s.shard_bytes > {QUERY_LIMIT} AS oversized
FROM leaf JOIN s ON s.depth = leaf.depth AND s.prefix = leaf.h >> ({BITS} - leaf.depth)
"""
