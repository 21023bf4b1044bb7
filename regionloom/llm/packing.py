"""Best-fit packing of documents into sequences of fixed length, under conflicts.

A document is cut into whole sequences of ``capacity`` words and a rest.  Rests
are packed from the longest down: each goes into the open bin with the least
room that holds it and does not conflict.  Bins are kept by residual room, with
a bit for each room that has bins; the successor search takes the least such
room, and goes on to the next until a compatible bin is found or none is left,
when a new bin opens.  A bin carries two bitmaps: of the sources in it (at most
one document of a source) and of the duplicate clusters in it (at most one
member of a cluster).

Rests are dealt by hash into packing groups of about ``group_words`` words and
``GROUP_ROWS`` rows, packed independently: a group is the unit of memory and of
recovery, and a hot source or cluster is spread over all groups.  Rows that are
equal in doc_id and cluster share a hash: a group that comes to more than twice
its rows or words is dealt on by the rows' places in their table, so that no
group holds more whatever repeats.  A source that holds much needs many bins;
it is never dropped.

Defined cases: a text without words gives one row without a bin; a null source
conflicts with nothing; texts that are equal are one cluster unless the caller
names a cluster column or asks for ``near`` copies, when the components of op3
are the clusters; repeated rows are packed each for itself, never in one
bin; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import word_count, written

CAPACITY = 1024
GROUP_WORDS = 1 << 21
GROUP_ROWS = 8192


def best_fit(items: list[tuple[int, int | None, int]], capacity: int) -> tuple[list[int], list[int]]:
    """Bins of ``items`` (size, source, cluster) taken in order: (bin of each, place in its bin)."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    sources: list[int] = []
    clusters: list[int] = []
    held: list[int] = []
    bins, places = [], []
    for size, source, cluster in items:
        own_source = 0 if source is None else 1 << source
        own_cluster = 1 << cluster
        found, search = None, open_rooms >> size << size
        while search and found is None:
            room = (search & -search).bit_length() - 1
            for at, b in enumerate(rooms[room]):
                if not sources[b] & own_source and not clusters[b] & own_cluster:
                    found = b
                    rooms[room].pop(at)
                    if not rooms[room]:
                        open_rooms &= ~(1 << room)
                    break
            search &= search - 1
        if found is None:
            found, room = len(held), capacity
            sources.append(0)
            clusters.append(0)
            held.append(0)
        sources[found] |= own_source
        clusters[found] |= own_cluster
        bins.append(found)
        places.append(held[found])
        held[found] += 1
        room -= size
        if room:
            rooms[room].append(found)
            open_rooms |= 1 << room
    return bins, places


def _measures() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")]


def _near(docs: DataFrame, seed: int) -> DataFrame:
    """The rows to pack, with a cluster for each component of near copies; texts stay where they are."""

    @F.pandas_udf("bigint")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([simhash.fingerprint(t) for t in batch], dtype="int64")

    rows = written(docs.select(*_measures(), of(F.col("text")).alias("fp")), "pack-prints")
    roots = simhash._rooted(rows.select("doc_id", "fp"), simhash.MOST).select("fp", "root")
    return rows.join(roots, "fp").select("doc_id", "source", "size", F.xxhash64("root", F.lit(seed)).alias("cluster"))


def pack(docs: DataFrame, capacity: int = CAPACITY, group_words: int = GROUP_WORDS, cluster: Column | None = None, near: bool = False, seed: int = 7) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start_word, n_words, bin, place, bin_words.

    ``bin`` names the sequence; words ``start_word`` to ``start_word + n_words``
    of the text go at ``place`` of it.
    """
    if near:
        if cluster is not None:
            raise ValueError("near copies are clusters of their own")
        rows = _near(docs, seed)
    else:
        key = F.xxhash64("text", F.lit(seed)) if cluster is None else F.xxhash64(cluster, F.lit(seed))
        rows = docs.select(*_measures(), key.alias("cluster"))
    rows = written(rows, "pack-rows")
    words, n = rows.agg(F.sum(F.col("size") % capacity), F.count("*")).first()
    groups = max(1, math.ceil((words or 0) / group_words), math.ceil(n / GROUP_ROWS))
    rest = F.col("size") % capacity
    full = F.floor(F.col("size") / capacity).cast("int")
    # cut sequences stand alone; their name is the document's place in its table, which the written rows keep
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    cuts = numbered.where(full > 0).select("doc_id", "row", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    cuts = cuts.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start_word"), F.lit(capacity).cast("long").alias("n_words"), F.concat_ws("-", F.lit("w"), "row", "piece").alias("bin"), F.lit(0).alias("place"), F.lit(capacity).cast("long").alias("bin_words"))
    empty = rows.where("size = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_word"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("string").alias("bin"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("bin_words"))
    rests = numbered.where(rest > 0).select("doc_id", "source", "cluster", "row", full.alias("piece"), (full.cast("long") * capacity).alias("start_word"), rest.cast("long").alias("n_words"), F.pmod(F.xxhash64("doc_id", "cluster", F.lit(seed)), F.lit(groups)).alias("group"))
    deals = F.greatest(F.ceil(F.count("*") / GROUP_ROWS), F.ceil(F.sum("n_words") / group_words))
    large = written(rests.groupBy("group").agg(deals.alias("deals"), ((F.count("*") > 2 * GROUP_ROWS) | (F.sum("n_words") > 2 * group_words)).alias("large")).where("large").drop("large"), "pack-large")
    if large.isEmpty():
        rests = rests.withColumn("deal", F.lit(0).cast("long"))
    else:
        rests = rests.join(large, "group", "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64("row", F.lit(seed)), "deals"), F.lit(0)))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "doc_id", "cluster", "source"], ascending=[False, True, True, True], na_position="last", kind="stable").reset_index(drop=True)
        source, _ = pd.factorize(pdf["source"])
        cluster, _ = pd.factorize(pdf["cluster"])
        items = [(n, None if s < 0 else s, c) for n, s, c in zip(pdf["n_words"].tolist(), source.tolist(), cluster.tolist(), strict=True)]
        bins, places = best_fit(items, capacity)
        pdf["bin"] = [f"{g}-{d}-{b}" for g, d, b in zip(pdf["group"].tolist(), pdf["deal"].tolist(), bins, strict=True)]
        pdf["place"] = pd.Series(places, dtype="int32")
        pdf["bin_words"] = pdf["n_words"].groupby(pd.Series(bins)).transform("sum") if len(pdf) else pd.Series(dtype="int64")
        return pdf[["doc_id", "piece", "start_word", "n_words", "bin", "place", "bin_words"]]

    found = rests.groupBy("group", "deal").applyInPandas(packed, "doc_id bigint, piece int, start_word bigint, n_words bigint, bin string, place int, bin_words bigint")
    return cuts.unionByName(found).unionByName(empty)
