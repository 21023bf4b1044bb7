"""Nearest-prototype classification by cosine, for one split or for many episodes at once.

Episodes are never looped over: prototypes of all episodes are one aggregate of
the support, and their queries one join with them by episode.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V


def prototypes(support: DataFrame, keys: list[str], label: str = "label", vector: str = "feature") -> DataFrame:
    """(keys, label, prototype): the unit vector of the mean of the raw vectors of a class."""
    means = V.mean_vectors(support, [*keys, label], vector, "_mean")
    return means.withColumn("prototype", V.l2_normalize(F.col("_mean"))).drop("_mean")


def score(queries: DataFrame, protos: DataFrame, keys: list[str], query_id: list[str], vector: str = "feature", label: str = "label") -> DataFrame:
    """(query_id, class, score) of every query against every class of its keys.

    Prototypes are classes, not rows; without keys they are broadcast if Spark's size estimate allows.
    """
    q = queries.select(*{*keys, *query_id}, V.l2_normalize(F.col(vector)).alias("_q"))
    p = protos.select(*keys, F.col(label).alias("class"), "prototype")
    both = q.join(p, list(keys)) if keys else q.crossJoin(p.agg(F.collect_list(F.struct("class", "prototype")).alias("_p"))).select(*query_id, "_q", F.explode("_p").alias("_s")).select(*query_id, "_q", "_s.*")
    return both.select(*{*keys, *query_id}, "class", V.dot(F.col("_q"), F.col("prototype")).alias("score"))


def argmax(scores: DataFrame, query_id: list[str], tie: list, value: str = "score", digits: int | None = None) -> DataFrame:
    """The best class of each query: (query_id, y_pred, score); ties by ``tie``, and with ``digits`` on rounded scores."""
    v = F.round(value, digits) if digits is not None else F.col(value)
    order = Window.partitionBy(*query_id).orderBy(v.desc(), *tie)
    return scores.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*query_id, F.col("class").alias("y_pred"), F.col(value).alias("score"))


def normalized_weights(whole: float, region: float) -> tuple[float, float]:
    if whole < 0 or region < 0 or whole + region <= 0:
        raise ValueError("weights must not be negative and not both zero")
    return whole / (whole + region), region / (whole + region)


def fuse_scores(whole: DataFrame, region: DataFrame, keys: list[str], whole_weight: float = 0.5, region_weight: float = 0.5) -> DataFrame:
    """(keys, class, whole_score, region_score, score); a class that one branch lacks scores 0 there."""
    a, b = normalized_weights(whole_weight, region_weight)
    both = whole.withColumnRenamed("score", "whole_score").join(region.withColumnRenamed("score", "region_score"), [*keys, "class"], "full_outer")
    both = both.fillna(0.0, ["whole_score", "region_score"])
    return both.withColumn("score", a * F.col("whole_score") + b * F.col("region_score"))


def episode_prototypes(episodes: DataFrame, features: DataFrame, keys: list[str], vector: str = "feature") -> DataFrame:
    """(keys, class, class_pos, prototype) of every episode: a class has its few shots only, summed in the order of the support as a loop does it."""
    support = episodes.where("role = 'support'").join(features.select("row_idx", F.col(vector).alias("_v")), "row_idx")
    shots = support.groupBy(*keys, F.col("label").alias("class")).agg(F.min("pos").alias("class_pos"), F.array_sort(F.collect_list(F.struct("pos", "_v"))).alias("_s"))
    first = F.transform(F.get("_s", F.lit(0))["_v"], lambda x: F.lit(0.0))
    added = F.aggregate("_s", first, lambda acc, s: F.zip_with(acc, s["_v"], lambda x, y: x + y))
    return shots.select(*keys, "class", "class_pos", V.let(F.transform(added, lambda x: x / F.size("_s")), V.l2_normalize).alias("prototype"))


def episode_scores(episodes: DataFrame, features: DataFrame, keys: list[str], vector: str = "feature") -> DataFrame:
    """(keys, pos, y_true, class, class_pos, score) for every query of every episode.

    ``episodes`` has keys, role, pos, row_idx, label; ``class_pos`` is the class's first place in the support, which breaks ties.
    """
    protos = episode_prototypes(episodes, features, keys, vector)
    query = episodes.where("role = 'query'").join(features.select("row_idx", V.l2_normalize(F.col(vector)).alias("_q")), "row_idx").select(*keys, "pos", F.col("label").alias("y_true"), "_q")
    return query.join(protos, keys).select(*keys, "pos", "y_true", "class", "class_pos", V.dot(F.col("_q"), F.col("prototype")).alias("score"))


def weight_grid(whole: DataFrame, region: DataFrame, weights: list[float], keys: list[str]) -> DataFrame:
    """(weight_idx, whole_weight, keys, pos, y_true, class, score): both branches are scored once for all weights."""
    on = [*keys, "pos", "y_true", "class"]
    both = whole.select(*on, F.col("score").alias("_w")).join(region.select(*on, F.col("score").alias("_r")), on, "full_outer").fillna(0.0, ["_w", "_r"])
    grid = F.array(*[F.struct(F.lit(i).alias("weight_idx"), F.lit(normalized_weights(w, 1 - w)[0]).alias("whole_weight")) for i, w in enumerate(weights)])
    out = both.withColumn("_g", F.explode(grid)).select("_g.*", *on, "_w", "_r")
    return out.select("weight_idx", "whole_weight", *on, (F.col("whole_weight") * F.col("_w") + (1 - F.col("whole_weight")) * F.col("_r")).alias("score"))


#: Numbers in a block of vectors at most (1 MB), and in one product of two blocks.
BLOCK = 1 << 17


def _blocks(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(_rows, _values, _width): vectors of one Arrow batch, cut into blocks of at most ``BLOCK`` numbers, with their keys."""
    each = df.select(F.struct(*[F.col(k) for k in keys] or [F.lit(0).alias("_")]).alias("_k"), V.doubles(F.col(vector)).alias("_v"))

    def pack(batches):
        for b in batches:
            widths = np.unique(b.column("_v").value_lengths().fill_null(-1))
            if len(widths) > 1 or (widths < 0).any():
                raise ValueError(f"vector lengths differ: {widths.tolist()}")
            step = max(1, BLOCK // max(1, *widths.tolist())) if len(widths) else 1
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                values = np.asarray(part.column("_v").flatten().to_numpy(zero_copy_only=False), "f8")
                rows = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("_k"))
                yield pa.RecordBatch.from_arrays([rows, pa.array([values.tobytes()], pa.binary()), pa.array(widths[:1], pa.int32())], ["_rows", "_values", "_width"])

    out = T.StructType().add("_rows", T.ArrayType(each.schema["_k"].dataType)).add("_values", T.BinaryType()).add("_width", T.IntegerType())
    return each.mapInArrow(pack, out)


def nearest_memory(tokens: DataFrame, memory: DataFrame, keys: list[str], vector: str = "token") -> DataFrame:
    """(keys, score): 1 - the highest cosine of each token to any memory vector (both normalised).

    Every token meets every memory vector: both are cut into bounded blocks,
    each pair of blocks is one matrix product of which the highest of each token
    is kept, and the highest of all pairs is the result.  Neither side is
    collected, so the memory may be of any size.  With an empty memory the
    highest is -2; null memory vectors count for nothing.
    """
    spark = tokens.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = _blocks(tokens, keys, vector).withColumn("_block", F.monotonically_increasing_id()).repartition(parts)
    nothing = spark.range(1).select(F.lit(b"").alias("_memory"), F.lit(0).alias("_memory_width"))
    held = _blocks(memory.where(F.col(vector).isNotNull()), [], vector).select(F.col("_values").alias("_memory"), F.col("_width").alias("_memory_width"))
    pairs = asked.crossJoin(held.unionByName(nothing).repartition(math.ceil(math.sqrt(parts))))
    kinds = [tokens.schema[k] for k in keys]

    def highest(batches):
        def found():
            return pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(np.full(len(top), block)), pa.array(np.arange(len(top), dtype="i4")), pa.array(top)], [*keys, "_block", "_at", "_top"])

        block = rows = top = None
        for b in batches:
            for r in range(b.num_rows):
                one = {n: b.column(n)[r] for n in b.schema.names}
                if block != one["_block"].as_py():
                    if block is not None:
                        yield found()
                    block, rows = one["_block"].as_py(), one["_rows"].values
                    top = np.full(len(rows), -2.0)
                    width = one["_width"].as_py()
                    q = np.frombuffer(one["_values"].as_buffer(), "f8").reshape(len(rows), width)
                if not (m := np.frombuffer(one["_memory"].as_buffer(), "f8")).size:
                    continue
                if one["_memory_width"].as_py() != width:
                    raise ValueError(f"vector lengths differ: {width} and {one['_memory_width'].as_py()}")
                m = m.reshape(-1, width).T
                step = max(1, BLOCK // m.shape[1])
                for at in range(0, len(q), step):
                    top[at : at + step] = np.maximum(top[at : at + step], (q[at : at + step] @ m).max(axis=1))
        if block is not None:
            yield found()

    out = T.StructType([T.StructField(k.name, k.dataType) for k in kinds]).add("_block", T.LongType()).add("_at", T.IntegerType()).add("_top", T.DoubleType())
    each = pairs.mapInArrow(highest, out)
    return each.groupBy(*keys, "_block", "_at").agg(F.max("_top").alias("_top")).select(*keys, (1 - F.col("_top")).alias("score"))
