"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: 150 % of all words are shared by weight; a source's share stops at
   twice its words and the excess goes to the others by weight (one pass over
   the sources in the order in which they fill up).
2. Blocks: each source is dealt into blocks of about ``block_words`` words and at
   most about ``BLOCK_ROWS`` rows by a hash of the row.  A target is so many whole
   passes over the source and a part of one more; in that part the blocks go in
   a hashed order until the words are reached.  In the block where they are
   reached, documents are taken from the longest down while they fit.
3. Tree: the root holds how many blocks each source gives.  A node splits its
   counts between its two halves of the shards by hypergeometric draws, one for
   each source from what the others left, so every level keeps all quotas
   exactly.  A draw costs the same whatever its counts.  A leaf is a shard.
4. A shard takes the next blocks in each source's permuted order (disjoint by
   construction) and is shuffled locally.

Draws are hashes of the seed and of what is drawn: reruns agree.  All steps are
DataFrame operations; after step 2 tables hold a row for each block, not for
each document, and windows over a source run in two levels, by hash range and
over range sums, so that one source with a third of all rows does not meet in
one task.

Defined cases: null text has 0 words; null source is a source, last in order;
documents of 0 words go with their block; rows equal in doc_id and text are
drawn together; an empty table gives no rows; columns of ``docs`` are kept by
``mix`` whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import uniform, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 1 << 16
BLOCK_ROWS = 1024
SHARD_WORDS = 1 << 22
SALTS = 32
_RANGE = 4096


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n_rows) -> with sid, weight, target.  A row for each source: these windows are over the sources alone."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sid", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size").cast("double"))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    before = F.coalesce(F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(fills.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (total * F.lit(share) - before) / left)
    # sources fill up in this order: the level of the first that does not is everybody's
    level = F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(Window.partitionBy(F.lit(0)))
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap")))).drop("cap", "level")


def _keyed(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(*columns, docs["source"].alias("source"), word_count(docs["text"]).alias("size"), F.xxhash64(docs["doc_id"], docs["text"]).alias("key"))


def _in_blocks(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``rows`` with their source's plan and block; the join is salted, as one source may hold much."""
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "of")
    rows = rows.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))
    both = rows.join(salted, rows["source"].eqNullSafe(salted["of"]) & (rows["salt"] == salted["salt"])).drop("salt", "of")
    return both.withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("n_blocks")))


def _running(df: DataFrame, key: Column, n: Column, value: Column) -> DataFrame:
    """``df`` with ``rank`` and ``before`` (sum of ``value``) in the order of ``key`` in [0, 1) within a source of about ``n`` rows."""
    df = df.withColumn("_key", key).withColumn("_value", value).withColumn("_range", F.floor(F.col("_key") * F.greatest(F.ceil(n / _RANGE), F.lit(1))))
    sums = df.groupBy("sid", "_range").agg(F.count("*").alias("_n"), F.sum("_value").alias("_s"))
    upto = Window.partitionBy("sid").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_s0"))
    own = Window.partitionBy("sid", "_range").orderBy("_key", "block")
    out = df.withColumn("rank", F.row_number().over(own)).withColumn("before", F.coalesce(F.sum("_value").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(sums, ["sid", "_range"]).withColumn("rank", F.col("rank") + F.col("_n0")).withColumn("before", F.col("before") + F.col("_s0"))
    return out.drop("_key", "_value", "_range", "_n0", "_s0")


#: Draws of up to so many items go item by item; larger ones by rejection, in at most ``_TRIES`` tries.
_FEW = 24
_TRIES = 48
#: Constants of the ratio-of-uniforms hat (Stadlober 1989): 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e).
_HAT = (2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e))
#: ln(n!) for n < 16, where the series below is not exact enough.
_LN_FACTORIAL = ", ".join(f"{math.lgamma(n + 1)!r}D" for n in range(16))


def _bound(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value`` once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _ln_factorial(n: str) -> str:
    """SQL: ln(n!) of a whole number as double, by Stirling's series."""
    series = f"z_ * ln(z_) - z_ + 0.5D * ln({2 * math.pi!r}D * z_) + 1D / (12 * z_) - 1D / (360 * z_ * z_ * z_) + 1D / (1260 * z_ * z_ * z_ * z_ * z_)"
    return _bound(n, "z_", f"CASE WHEN z_ < 16 THEN element_at(array({_LN_FACTORIAL}), CAST(least(greatest(z_, 0D), 15D) AS INT) + 1) ELSE {series} END")


def _chance(*parts: str) -> str:
    """SQL: as ``common.uniform``."""
    return f"(CAST(shiftrightunsigned(xxhash64({', '.join(parts)}), 11) AS DOUBLE) / {float(1 << 53)!r}D)"


def hypergeometric(total: str, good: str, drawn: str, *name: str) -> str:
    """SQL: how many of ``drawn`` items, taken without replacement from ``total``, are among the ``good``; ``name`` names the draw.

    The cost does not grow with the counts: the least of drawn, good and what is left of either is drawn item by item
    if it is small; else a ratio-of-uniforms hat over the distribution is thrown at, three tries in four hitting.
    """
    # the four forms of one draw: (items, hits among m, offset, sign)
    form = lambda items, hits, offset, sign: f"named_struct('c', {items}, 'h', {hits}, 'o', {offset}, 's', {sign}L)"
    forms = f"CASE WHEN v.k <= least(v.n, v.m - v.k, v.m - v.n) THEN {form('v.k', 'v.n', '0L', 1)} WHEN v.n <= least(v.m - v.k, v.m - v.n) THEN {form('v.n', 'v.k', '0L', 1)} WHEN v.m - v.k <= v.m - v.n THEN {form('v.m - v.k', 'v.n', 'v.n', -1)} ELSE {form('v.m - v.n', 'v.k', 'v.k', -1)} END"
    hit = f"CASE WHEN {_chance(*name, 'i')} * a.m < a.n THEN 1L ELSE 0L END"
    step = _bound(hit, "t", "named_struct('m', a.m - 1, 'n', a.n - t, 'x', a.x + t)")
    items = "CASE WHEN f.c > 0 THEN sequence(1L, f.c) ELSE CAST(array() AS ARRAY<BIGINT>) END"
    by_item = _bound(forms, "f", f"f.o + f.s * aggregate({items}, named_struct('m', v.m, 'n', f.h, 'x', 0L), (a, i) -> {step}, a -> a.x)")
    # of both kinds the fewer (g), and of the sample and the rest the smaller (k): the others follow
    weight = lambda z: " + ".join(_ln_factorial(n) for n in (z, f"w.g - {z}", f"w.k - {z}", f"w.m - w.g - w.k + {z}"))
    fewer = "named_struct('m', CAST(v.m AS DOUBLE), 'g', CAST(least(v.n, v.m - v.n) AS DOUBLE), 'k', CAST(least(v.k, v.m - v.k) AS DOUBLE))"
    shape = "named_struct('m', e.m, 'g', e.g, 'k', e.k, 'center', e.k * e.g / e.m + 0.5D, 'width', sqrt((e.m - e.k) * e.k * (e.g / e.m) * (1 - e.g / e.m) / (e.m - 1) + 0.5D), 'mode', CAST(floor((e.k + 1) * (e.g + 1) / (e.m + 2)) AS DOUBLE))"
    hat = f"named_struct('m', w.m, 'g', w.g, 'k', w.k, 'mode', w.mode, 'center', w.center, 'scale', {_HAT[0]!r}D * w.width + {_HAT[1]!r}D, 'end', least(least(w.k, w.g) + 1, CAST(floor(w.center + 16 * w.width) AS DOUBLE)), 'top', {weight('w.mode')})"
    pair = f"named_struct('u', greatest({_chance(*name, 'j', '1')}, 1e-300D), 'p', {_chance(*name, 'j', '2')})"
    accept = _bound("CAST(floor(y) AS DOUBLE)", "q", f"CASE WHEN 2 * ln(x.u) <= w.top - ({weight('q')}) THEN q END")
    place = _bound("w.center + w.scale * (x.p - 0.5D) / x.u", "y", f"CASE WHEN y >= 0 AND y < w.end THEN {accept} END")
    tries = f"coalesce(aggregate(sequence(1, {_TRIES}), CAST(NULL AS DOUBLE), (found, j) -> CASE WHEN found IS NOT NULL THEN found ELSE {_bound(pair, 'x', place)} END), w.mode)"
    thrown = _bound(_bound(_bound(_bound(fewer, "e", shape), "w", hat), "w", f"CAST({tries} AS BIGINT)"), "z", "CASE WHEN v.n > v.m - v.n THEN least(v.k, v.m - v.k) - z ELSE z END")
    thrown = _bound(thrown, "z", "CASE WHEN v.k > v.m - v.k THEN v.n - z ELSE z END")
    return _bound(f"named_struct('m', {total}, 'n', {good}, 'k', {drawn})", "v", f"CASE WHEN least(v.k, v.n, v.m - v.k, v.m - v.n) <= {_FEW} THEN {by_item} ELSE {thrown} END")


def split_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(sid, k blocks) -> (shard, sid, k): the splitting tree.  Every sum over shards is the quota, shard totals differ by one at most.

    A node is one row with a count for each source; its draw costs the same whatever the counts, so the root too is a small task.
    """
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + p["k"])
    nodes = quotas.where("k > 0").groupBy().agg(F.sort_array(F.collect_list(F.struct("sid", F.col("k").cast("long").alias("k")))).alias("parts"))
    nodes = nodes.select(F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"), total.alias("all"), "parts")
    none = "CAST(array() AS ARRAY<STRUCT<sid: INT, k: BIGINT>>)"
    mid = "CAST(floor((lo + hi) / 2) AS INT)"
    room = f"CAST(floor(all * {mid} / {n_shards}) - floor(all * lo / {n_shards}) AS BIGINT)"
    piece = lambda k: f"filter(array(named_struct('sid', p.sid, 'k', {k})), g -> g.k > 0)"
    # the left half's share of a source's blocks: so many of its free places among all that are left
    draw = _bound(hypergeometric("acc.m", "acc.n", "p.k", f"{seed}", "lo", "hi", "p.sid"), "d", f"named_struct('m', acc.m - p.k, 'n', acc.n - d, 'left', concat(acc.left, {piece('d')}), 'right', concat(acc.right, {piece('p.k - d')}))")
    dealt = f"aggregate(parts, named_struct('m', aggregate(parts, 0L, (s, p) -> s + p.k), 'n', {room}, 'left', {none}, 'right', {none}), (acc, p) -> {draw})"
    node = lambda lo, hi, parts: f"named_struct('lo', {lo}, 'hi', {hi}, 'all', all, 'parts', {parts})"
    halves = _bound(dealt, "h", f"array({node('lo', mid, 'h.left')}, {node(mid, 'hi', 'h.right')})")
    level = f"explode(CASE WHEN hi - lo > 1 THEN {halves} ELSE array({node('lo', 'hi', 'parts')}) END) AS v"
    for depth in range((n_shards - 1).bit_length()):
        if depth and depth % 3 == 0:
            # a level's expression is not written out again in the next
            nodes = written(nodes, "mix-nodes")
        if depth == 6:
            nodes = nodes.repartition("lo", "hi")
        nodes = nodes.selectExpr(level).select("v.*")
    return nodes.select(F.col("lo").alias("shard"), F.explode("parts").alias("p")).select("shard", "p.sid", "p.k")


def _longest_that_fit(docs: Column, room: Column) -> Column:
    """The keys among ``docs`` (size, key; from the longest down) that are taken while they fit."""
    start = F.struct(room.alias("room"), F.array().cast("array<bigint>").alias("keys"))
    step = lambda a, d: F.when(d["size"] <= a["room"], F.struct((a["room"] - d["size"]).alias("room"), F.concat(a["keys"], F.array(d["key"])).alias("keys"))).otherwise(a)
    return F.aggregate(docs, start, step, lambda a: a["keys"])


class Mixture:
    """The plan of a mix: its tables are written in the shared folder as it is made."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 11):
        self.docs, self.seed = docs, seed
        rows = written(_keyed(docs, "doc_id"), "mix-rows")
        sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
        plan = source_targets(sizes, weights, share, most)
        want = F.round("target").cast("long")
        full = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long")
        n_blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words), F.ceil(F.col("n_rows") / BLOCK_ROWS)).cast("long")
        self.plan = written(plan.select("source", "sid", "source_size", "target", full.alias("full"), (want - full * F.col("source_size")).alias("rest"), n_blocks.alias("n_blocks")).coalesce(1), "mix-plan")
        self.rows = written(_in_blocks(rows, self.plan, seed), "mix-blocks")
        blocks = self.rows.groupBy("sid", "block", "n_blocks", "full", "rest").agg(F.sum("size").alias("words"))
        blocks = _running(blocks, uniform(F.lit(seed), F.lit(1), F.col("sid"), F.col("block")), F.col("n_blocks"), F.col("words"))
        # a pass that is not whole: blocks until the rest is reached, the last with the room that is left
        room = F.col("rest") - F.col("before")
        passes = F.filter(F.array(F.when(F.col("full") > 0, F.struct(F.lit(0).alias("pass"), F.lit(None).cast("long").alias("room"))), F.when(F.col("full") > 1, F.struct(F.lit(1).alias("pass"), F.lit(None).cast("long").alias("room"))), F.when(room > 0, F.struct(F.col("full").cast("int").alias("pass"), F.when(F.col("words") > room, room).alias("room")))), lambda x: x.isNotNull())
        if most > 2:
            raise ValueError("a source is passed over twice at most")
        draws = blocks.select("sid", "block", "n_blocks", F.explode(passes).alias("p")).select("sid", "block", "n_blocks", "p.*")
        draws = written(_running(draws, (F.col("pass") + uniform(F.lit(seed), F.lit(2), F.col("sid"), F.col("block"), F.col("pass"))) / 3, 3 * F.col("n_blocks"), F.lit(1)), "mix-draws")
        words = self.plan.agg(F.sum("target")).first()[0] or 0
        self.n_shards = max(1, math.ceil(words / shard_words))
        quotas = split_quotas(draws.groupBy("sid").agg(F.count("*").alias("k")), self.n_shards, seed)
        upto = Window.partitionBy("sid").orderBy("shard")
        quotas = quotas.withColumn("end", F.sum("k").over(upto)).select("sid", "shard", F.explode(F.sequence(F.col("end") - F.col("k") + 1, F.col("end"))).alias("rank"))
        dealt = draws.join(quotas, ["sid", "rank"])
        whole = F.struct("pass", "shard")
        self.blocks = written(dealt.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.when(F.col("room").isNull(), whole))).alias("whole"), F.max(F.when(F.col("room").isNotNull(), F.struct("pass", "shard", "room"))).alias("cut")), "mix-dealt")
        cut = self.blocks.where("cut is not null").select("sid", "block", "cut.room")
        in_cut = self.rows.select("sid", "block", "key", "size").join(cut, ["sid", "block"]).groupBy("sid", "block", "room", "key").agg(F.sum("size").alias("size"))
        longest = F.sort_array(F.collect_list(F.struct("size", "key")), asc=False)
        self.cut = written(in_cut.groupBy("sid", "block", "room").agg(longest.alias("d")).select("sid", "block", F.explode(_longest_that_fit(F.col("d"), F.col("room"))).alias("key"), F.lit(True).alias("in_cut")), "mix-cut")

    def _draws(self, rows: DataFrame) -> DataFrame:
        """``rows`` (sid, block, key and others) with ``draws``: pass and shard of each time that they are taken."""
        both = rows.join(self.blocks, ["sid", "block"], "left").join(self.cut, ["sid", "block", "key"], "left")
        none = F.array().cast("array<struct<pass:int,shard:int>>")
        last = F.when(F.col("in_cut"), F.array(F.struct(F.col("cut.pass").alias("pass"), F.col("cut.shard").alias("shard")))).otherwise(none)
        return both.withColumn("draws", F.concat(F.coalesce("whole", none), last)).drop("whole", "cut", "in_cut")

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken, shards: a row for each document, taken or not."""
        d = self._draws(self.rows)
        return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.transform("draws", lambda x: x["shard"]).alias("shards"))

    def mix(self) -> DataFrame:
        """The mixed documents, with the columns that they have: each as often as it is drawn, by shard, shuffled within it."""
        docs = self.docs
        rows = _in_blocks(_keyed(docs, F.struct(*[docs[c] for c in docs.columns]).alias("row")), self.plan, self.seed)
        out = self._draws(rows).select("row", "key", F.explode("draws").alias("d"))
        # a shard is a partition: hashing would put several into one
        out = out.repartitionById(self.n_shards, F.col("d.shard")).sortWithinPartitions("d.shard", F.xxhash64("key", "d.pass", F.lit(self.seed)))
        return out.select("row.*")


def taken(docs: DataFrame, **options) -> DataFrame:
    return Mixture(docs, **options).taken()


def mix(docs: DataFrame, **options) -> DataFrame:
    return Mixture(docs, **options).mix()
