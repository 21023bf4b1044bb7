"""The reference operators over the standard tables, each with the DuckDB SQL that must give the same rows.

The tables have no images: a vector of ``embeddings`` (64 values) stands for a
feature, or for a heatmap of 8 x 8 cells; boxes are derived from keys; labels
and predictions from ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .functions import boxes as B
from .functions import grids as G
from .functions import paths as P
from .functions import vectors as V
from .operators import classify, episodes, iou, merge, metrics, regions, validate
from .plans import evaluation

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL for its rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_idx, label, feature."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("label").cast("string").alias("label"), V.doubles(F.col("embedding")).alias("feature"))


def r6(c: Column | str) -> Column:
    """Six decimals, and never a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# -- vectors -------------------------------------------------------------------------------------------------------

_E = """
e AS (SELECT vec_id, label::VARCHAR AS label, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) t(i)),"""
_PROTO = _E + """
m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
p AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m),
q AS (SELECT vec_id, label AS y_true, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM e),
s AS (SELECT q.vec_id, q.y_true, p.label AS class, sum(q.x * p.x) AS score FROM q JOIN p USING (i) GROUP BY ALL),
b AS (SELECT vec_id, y_true, class AS y_pred, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, class) = 1)
"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    protos = classify.prototypes(f, [])
    queries = f.withColumnRenamed("label", "y_true")
    return classify.score(queries, protos, [], ["row_idx", "y_true"])


@query("WITH " + _PROTO + "SELECT label, i::INT AS pos, round(x, 6) + 0.0 AS value FROM p")
def prototype_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    protos = classify.prototypes(features(spark, sf_dir), [])
    return protos.select("label", F.posexplode("prototype").alias("pos", "x")).select("label", "pos", r6("x").alias("value"))


@query("WITH " + _PROTO + "SELECT vec_id, class, round(score, 6) + 0.0 AS score FROM s")
def prototype_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select(F.col("row_idx").alias("vec_id"), "class", r6("score").alias("score"))


@query("WITH " + _PROTO + "SELECT vec_id, y_true, y_pred, round(score, 6) + 0.0 AS score FROM b")
def prototype_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = classify.argmax(_scores(spark, sf_dir), ["row_idx", "y_true"], [F.col("class").asc()], digits=9)
    return best.select(F.col("row_idx").alias("vec_id"), "y_true", "y_pred", r6("score").alias("score"))


_METRICS = """
mc AS (SELECT {keys} y_true, y_pred, count(*)::BIGINT AS n FROM {rows} GROUP BY ALL),
mu AS (SELECT {keys} y_true AS label, n AS t, 0 AS p, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS hit FROM mc
      UNION ALL SELECT {keys} y_pred, 0, n, 0 FROM mc),
pc AS (SELECT {keys} label, sum(t)::BIGINT AS true_count, sum(p)::BIGINT AS pred_count, sum(hit)::BIGINT AS correct FROM mu GROUP BY ALL),
f AS (SELECT *, coalesce(correct / nullif(pred_count, 0), 0)::DOUBLE AS precision, coalesce(correct / nullif(true_count, 0), 0)::DOUBLE AS recall,
             coalesce(2.0 * correct / nullif(true_count + pred_count, 0), 0)::DOUBLE AS f1 FROM pc),
sc AS (SELECT {keys} sum(true_count)::BIGINT AS n, sum(correct)::DOUBLE / sum(true_count) AS accuracy,
              avg(recall) FILTER (true_count > 0) AS balanced_accuracy, avg(f1) AS macro_f1 FROM f GROUP BY ALL)
"""


def _metrics_sql(rows: str, keys: str = "") -> str:
    return _METRICS.format(rows=rows, keys=keys)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


_SC = "round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_f1, 6) AS macro_f1"
_MEASURES = ("accuracy", "balanced_accuracy", "macro_f1")


@query("WITH " + _PROTO + "," + _metrics_sql("b") + f"SELECT n, {_SC} FROM sc")
def prototype_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = classify.argmax(_scores(spark, sf_dir), ["row_idx", "y_true"], [F.col("class").asc()], digits=9)
    return _rounded(metrics.scores(metrics.confusion(best)), *_MEASURES)


_BRANCH = """
{n}m AS (SELECT label, i, avg(x) AS x FROM e WHERE i BETWEEN {a} AND {b} GROUP BY ALL),
{n}p AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM {n}m),
{n}q AS (SELECT vec_id, label AS y_true, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM e WHERE i BETWEEN {a} AND {b}),
{n}s AS (SELECT q.vec_id, q.y_true, p.label AS class, sum(q.x * p.x) AS score FROM {n}q q JOIN {n}p p USING (i) GROUP BY ALL),"""
_TWO = _E + _BRANCH.format(n="w", a=0, b=31) + _BRANCH.format(n="r", a=32, b=63)
_FUSED = """
z AS (SELECT k, wt, vec_id, y_true, class, wt * ws.score + (1 - wt) * rs.score AS score FROM ws JOIN rs USING (vec_id, y_true, class), (VALUES {weights}) g(k, wt)),
b AS (SELECT k, wt, vec_id, y_true, class AS y_pred, score FROM z QUALIFY row_number() OVER (PARTITION BY k, vec_id ORDER BY round(score, 9) DESC, class) = 1)"""


def _branches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f, out = features(spark, sf_dir), []
    for start in (1, 33):
        half = f.withColumn("feature", F.slice("feature", start, 32))
        protos = classify.prototypes(half, [])
        out.append(classify.score(half.select("row_idx", F.col("label").alias("y_true"), "feature"), protos, [], ["row_idx", "y_true"]))
    return out[0], out[1]


@query("WITH " + _TWO + _FUSED.format(weights="(0, 0.75::DOUBLE)") + "SELECT vec_id, y_true, y_pred, round(score, 6) + 0.0 AS score FROM b")
def region_context_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, region = _branches(spark, sf_dir)
    fused = classify.fuse_scores(whole, region, ["row_idx", "y_true"], 0.75, 0.25)
    best = classify.argmax(fused, ["row_idx", "y_true"], [F.col("class").asc()], digits=9)
    return best.select(F.col("row_idx").alias("vec_id"), "y_true", "y_pred", r6("score").alias("score"))


@query("WITH " + _TWO + _FUSED.format(weights="(0, 0.0::DOUBLE), (1, 0.25::DOUBLE), (2, 0.5::DOUBLE), (3, 1.0::DOUBLE)") + "," + _metrics_sql("b", "k, wt,") + f"SELECT k AS weight_idx, wt AS whole_weight, n, {_SC} FROM sc")
def region_context_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, region = (d.withColumn("pos", F.col("row_idx")) for d in _branches(spark, sf_dir))
    fused = classify.weight_grid(whole, region, [0.0, 0.25, 0.5, 1.0], [])
    keys = ["weight_idx", "whole_weight"]
    best = classify.argmax(fused, [*keys, "pos", "y_true"], [F.col("class").asc()], digits=9)
    return _rounded(metrics.scores(metrics.confusion(best, keys), keys), *_MEASURES)


def _digest(df: DataFrame) -> DataFrame:
    """vec_id, n and two sums that depend on every element and its place."""
    weighted = V.total(F.transform("v", lambda x, i: x * (i + 1)))
    return df.select(F.col("row_idx").alias("vec_id"), F.size("v").alias("n"), r6(V.total(F.col("v"))).alias("plain_sum"), r6(weighted).alias("place_sum"))


_DIGEST = "SELECT vec_id, count(*)::INT AS n, round(sum(v), 6) + 0.0 AS plain_sum, round(sum(v * (i + 1)), 6) + 0.0 AS place_sum FROM v GROUP BY ALL"


@query("WITH " + _E + "v AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS v FROM e)" + _DIGEST)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(features(spark, sf_dir).withColumn("v", V.l2_normalize(F.col("feature"))))


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    a = f.select(F.col("row_idx"), F.slice("feature", 1, 32).alias("a"))
    b = f.select(F.col("row_idx"), F.slice("feature", 33, 32).alias("b"))
    return a.join(b, "row_idx")


@query("WITH " + _E + "v AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id, i // 32)) AS v FROM e)" + _DIGEST)
def feature_fuse_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_halves(spark, sf_dir).withColumn("v", V.fuse(F.col("a"), F.col("b"), "concat", normalize_input=True)))


@query("WITH " + _E + "h AS (SELECT vec_id, i % 32 AS i, sum(CASE WHEN i < 32 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END * x) AS x FROM e GROUP BY ALL), v AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS v FROM h)" + _DIGEST)
def feature_fuse_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_halves(spark, sf_dir).withColumn("v", V.fuse(F.col("a"), F.col("b"), "weighted-sum", 0.25, normalize_output=True)))


_FORMS = """
t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '[' || p_size || ', ' || (p_partkey % 9) || '.5]' WHEN 1 THEN p_size || ',' || (p_partkey % 9) || '.5'
      WHEN 2 THEN '  ' || p_size || '   ' || (p_partkey % 9) || '.5 ' ELSE p_size || ', ' || (p_partkey % 9) || '.5' END AS text FROM part)"""


@query("SELECT p_partkey, 2 AS n, (p_size + p_partkey % 9 + 0.5)::DOUBLE AS total FROM part")
def vector_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part_forms")
    t = spark.sql("WITH " + _FORMS.replace("FROM part", "FROM part_forms") + " SELECT * FROM t").withColumn("v", V.parse_vector(F.col("text")))
    return t.select("p_partkey", F.size("v").alias("n"), V.total(F.col("v")).alias("total"))


@query("WITH " + _E + """
t AS (SELECT vec_id, i // 8 AS k, i % 8 AS d, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id, i // 8)) AS x FROM e),
c AS (SELECT vec_id, d, avg(x) AS x FROM t GROUP BY ALL), n AS (SELECT vec_id, d, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM c)
SELECT vec_id, k::INT AS patch, round(1 - sum(t.x * n.x), 6) + 0.0 AS score FROM t JOIN n USING (vec_id, d) GROUP BY ALL""")
def patch_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    tokens = F.transform(V.rows_of(F.col("feature"), F.lit(8)), V.l2_normalize)
    each = f.select("row_idx", tokens.alias("t")).select("row_idx", F.posexplode(V.patch_contrast(F.col("t"))).alias("patch", "s"))
    return each.select(F.col("row_idx").alias("vec_id"), "patch", r6("s").alias("score"))


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_idx, label, patch, token: eight normalised tokens of eight values for each image."""
    return features(spark, sf_dir).select("row_idx", "label", F.posexplode(F.transform(V.rows_of(F.col("feature"), F.lit(8)), V.l2_normalize)).alias("patch", "token"))


@query("WITH " + _E + """
t AS (SELECT vec_id, label, i // 8 AS k, i % 8 AS d, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id, i // 8)) AS x FROM e),
m AS (SELECT * FROM t WHERE label = '0'),
s AS (SELECT q.vec_id, q.k, m.vec_id AS mv, m.k AS mk, sum(q.x * m.x) AS c FROM t q JOIN m USING (d) GROUP BY ALL)
SELECT vec_id, k::INT AS patch, round(1 - max(c), 6) + 0.0 AS score FROM s GROUP BY ALL""")
def nearest_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every patch of every image against every patch of the images of label 0."""
    tokens = _patches(spark, sf_dir)
    out = classify.nearest_memory(tokens, tokens.where("label = '0'"), ["row_idx", "patch"])
    return out.select(F.col("row_idx").alias("vec_id"), "patch", r6("score").alias("score"))


# -- metrics on derived predictions --------------------------------------------------------------------------------

_PRED = """
SELECT l_suppkey % 20 AS episode, l_orderkey * 8 + l_linenumber AS pos, 'c' || (l_partkey % 7) AS y_true,
       CASE WHEN l_orderkey % 3 = 0 THEN 'c' || ((l_partkey + l_suppkey) % 8) ELSE 'c' || (l_partkey % 7) END AS y_pred,
       CASE WHEN l_orderkey % 5 = 0 THEN 'c' || ((l_partkey + l_linenumber) % 7) ELSE 'c' || (l_partkey % 7) END AS y_base
FROM lineitem"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PRED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


@query("WITH b AS (" + _PRED + ")," + _metrics_sql("b") + f"SELECT n, {_SC} FROM sc")
def accuracy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.scores(metrics.confusion(_predictions(spark, sf_dir))), *_MEASURES)


@query("WITH b AS (" + _PRED + ")," + _metrics_sql("b") + "SELECT label, true_count, pred_count, correct, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.per_class(metrics.confusion(_predictions(spark, sf_dir))), "precision", "recall", "f1")


@query("SELECT y_true, y_pred, count(*) AS count FROM (" + _PRED + ") GROUP BY ALL")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_predictions(spark, sf_dir))


@query("WITH b AS (" + _PRED + """), c AS (SELECT y_true, y_pred, count(*) AS count, min(pos) AS first_pos FROM b GROUP BY ALL),
s AS (SELECT *, count / sum(count) OVER (PARTITION BY y_true) AS f FROM c)
SELECT (row_number() OVER (ORDER BY count DESC, f DESC, first_pos, y_true, y_pred))::INT AS rank, y_true, y_pred, count, round(f, 6)::DOUBLE AS fraction_of_true
FROM s WHERE y_true <> y_pred QUALIFY rank <= 20""")
def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.top_confusions(metrics.confusion(_predictions(spark, sf_dir), order="pos"), k=20), "fraction_of_true")


@query("WITH a AS (" + _PRED + """), b AS (SELECT y_true, y_pred, 'r' AS m FROM a UNION ALL SELECT y_true, y_base, 'b' FROM a),""" + _metrics_sql("b", "m,") + """
, r AS (SELECT * FROM f WHERE m = 'r'), o AS (SELECT * FROM f WHERE m = 'b')
SELECT label, coalesce(r.true_count, 0) AS true_count, round(coalesce(r.recall, 0), 6) AS region_recall, round(coalesce(o.recall, 0), 6) AS baseline_recall,
       round(coalesce(r.recall, 0) - coalesce(o.recall, 0), 6) + 0.0 AS recall_delta, round(coalesce(r.f1, 0), 6) AS region_f1, round(coalesce(o.f1, 0), 6) AS baseline_f1,
       round(coalesce(r.f1, 0) - coalesce(o.f1, 0), 6) + 0.0 AS f1_delta, coalesce(r.correct, 0) AS region_correct, coalesce(o.correct, 0) AS baseline_correct,
       coalesce(r.correct, 0) - coalesce(o.correct, 0) AS correct_delta FROM r FULL JOIN o USING (label)""")
def per_class_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir)
    sides = [metrics.per_class(metrics.confusion(p.select("y_true", F.col(c).alias("y_pred")))) for c in ("y_pred", "y_base")]
    return _rounded(metrics.compare_per_class(*sides), "region_recall", "baseline_recall", "recall_delta", "region_f1", "baseline_f1", "f1_delta")


@query("WITH b AS (" + _PRED + ")," + _metrics_sql("b", "episode,") + f"SELECT episode, n, {_SC} FROM sc")
def episode_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.scores(metrics.confusion(_predictions(spark, sf_dir), ["episode"]), ["episode"]), *_MEASURES)


@query("WITH b AS (" + _PRED + ")," + _metrics_sql("b", "episode,") + "SELECT " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(coalesce(stddev_samp({m}), 0), 6) AS {m}_stdev" for m in _MEASURES) + " FROM sc")
def episode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = metrics.scores(metrics.confusion(_predictions(spark, sf_dir), ["episode"]), ["episode"])
    return _rounded(metrics.mean_stdev(each, [], list(_MEASURES)), *[f"{m}_{k}" for m in _MEASURES for k in ("mean", "stdev")])


# -- episodes ------------------------------------------------------------------------------------------------------

_HASHED = """
w AS (SELECT s.i AS setting_idx, n_way, k_shot, e AS episode_idx, 42 + s.i * 100000 + e AS seed FROM (VALUES (0, 5, 1), (1, 5, 3)) s(i, n_way, k_shot), range(20) t(e)),
n AS (SELECT label::VARCHAR AS label, count(*) AS n FROM embeddings GROUP BY ALL),
c AS (SELECT w.*, label FROM w JOIN n ON n >= k_shot + 5 QUALIFY row_number() OVER (PARTITION BY setting_idx, episode_idx ORDER BY sha256(seed || ':' || label)) <= n_way),
x AS (SELECT c.*, vec_id, row_number() OVER (PARTITION BY setting_idx, episode_idx, c.label ORDER BY sha256(seed || ':' || vec_id)) AS r FROM c JOIN embeddings v ON v.label::VARCHAR = c.label),
d AS (SELECT setting_idx::INT AS setting_idx, episode_idx::INT AS episode_idx, seed::BIGINT AS seed, CASE WHEN r <= k_shot THEN 'support' ELSE 'query' END AS role, vec_id AS row_idx, label FROM x WHERE r <= k_shot + 5)"""


@query("WITH " + _HASHED + "SELECT * FROM d")
def episode_sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.sample_hashed(features(spark, sf_dir).select("row_idx", "label"), [(5, 1), (5, 3)], 20, 5)


def _hashed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    drawn = episodes.sample_hashed(f.select("row_idx", "label"), [(5, 1), (5, 3)], 20, 5).withColumn("pos", F.col("row_idx"))
    scores = classify.episode_scores(drawn, f, ["setting_idx", "episode_idx"])
    return classify.argmax(scores, ["setting_idx", "episode_idx", "pos", "y_true"], [F.col("class").asc()], digits=9)


@query("WITH " + _HASHED + "," + _E + """
m AS (SELECT setting_idx, episode_idx, d.label AS class, i, avg(x) AS x FROM d JOIN e ON e.vec_id = d.row_idx WHERE role = 'support' GROUP BY ALL),
p AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY setting_idx, episode_idx, class)) AS u FROM m),
u AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM e),
s AS (SELECT d.setting_idx, d.episode_idx, d.row_idx, d.label AS y_true, p.class, sum(p.u * u.x) AS score FROM d JOIN p USING (setting_idx, episode_idx) JOIN u ON u.vec_id = d.row_idx AND u.i = p.i WHERE role = 'query' GROUP BY ALL),
b AS (SELECT *, class AS y_pred FROM s QUALIFY row_number() OVER (PARTITION BY setting_idx, episode_idx, row_idx ORDER BY round(score, 9) DESC, class) = 1),
""".replace("e AS (", "e AS (") + _metrics_sql("b", "setting_idx, episode_idx,") + f"SELECT setting_idx, episode_idx, n, {_SC} FROM sc")
def episode_eval_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["setting_idx", "episode_idx"]
    return _rounded(metrics.scores(metrics.confusion(_hashed_predictions(spark, sf_dir), keys), keys), *_MEASURES)


@query()
def episode_sample_mt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.sample(features(spark, sf_dir).select("row_idx", "label"), episodes.parse_grid(evaluation.GRID), 200, 5)


@query()
def few_shot_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return evaluation.few_shot_grid(f.select("row_idx", "label"), f.select("row_idx", "feature"), count=200)


@query()
def region_context_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    whole, region = (f.select("row_idx", F.slice("feature", k, 32).alias("feature")) for k in (1, 33))
    return evaluation.region_context_grid(f.select("row_idx", "label"), whole, region, [0.25, 0.5, 0.75], count=200)


@query("""
WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id)) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents),
t AS (SELECT *, CASE WHEN n <= 2 THEN 0 ELSE greatest(1, round_even(n * 0.15::DOUBLE, 0)) END AS nt FROM d),
v AS (SELECT *, CASE WHEN n - nt <= 2 THEN 0 ELSE greatest(1, round_even((n - nt) * 0.15::DOUBLE, 0)) END AS nv FROM t)
SELECT doc_id, lang, CASE WHEN p < nt THEN 'test' WHEN p < nt + nv THEN 'val' ELSE 'train' END AS split FROM v""")
def stratified_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.assign_splits_hashed(table(spark, sf_dir, "documents").select("doc_id", "lang"), row="doc_id", label="lang")


# -- boxes ---------------------------------------------------------------------------------------------------------

_BOXES = """
SELECT l_orderkey * 8 + l_linenumber AS row_idx, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_partkey % 31 = 0 THEN '' WHEN l_partkey % 37 = 0 THEN '0,0,0,10' WHEN l_partkey % 41 = 0 THEN '1,2,x,4'
            ELSE (l_partkey % 50) || '.5,' || (l_suppkey % 40) || '; ' || (l_partkey % 50 + 6 + l_linenumber * 3) || ',' || (l_suppkey % 40 + 9) END AS bbox,
       CASE WHEN l_suppkey % 29 = 0 THEN NULL WHEN l_suppkey % 23 = 0 THEN '5,5,5,5'
            ELSE (l_partkey % 50 + l_linenumber) || ',' || (l_suppkey % 40 - 2) || ',' || (l_partkey % 50 + 12) || ',' || (l_suppkey % 40 + 7) || '.25' END AS other
FROM lineitem"""
_PARSED = """
b AS (SELECT *, list_transform(list_filter(list_transform(string_split(replace({c}, ';', ','), ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: try_cast(x AS DOUBLE)) AS n FROM {t}),
{out} AS (SELECT * EXCLUDE (n), CASE WHEN len(n) = 4 AND len(list_filter(n, lambda x: x IS NULL)) = 0 AND n[3] > n[1] AND n[4] > n[2] THEN n END AS {name} FROM b),"""


def _parsed_sql(t: str, c: str, out: str, name: str) -> str:
    return _PARSED.replace("b AS", f"b_{out} AS").replace("FROM b)", f"FROM b_{out})").format(t=t, c=c, out=out, name=name)


_IOU = "l AS (" + _BOXES + ")," + _parsed_sql("l", "bbox", "g", "gt") + _parsed_sql("g", "other", "h", "ps") + """
i AS (SELECT *, CASE WHEN other IS NULL THEN 'missing_pseudo' WHEN gt IS NULL THEN 'invalid_gt_bbox' WHEN ps IS NULL THEN 'invalid_pseudo_bbox' ELSE 'matched' END AS status,
        greatest(0.0::DOUBLE, least(gt[3], ps[3]) - greatest(gt[1], ps[1])) * greatest(0.0::DOUBLE, least(gt[4], ps[4]) - greatest(gt[2], ps[2])) AS shared,
        (gt[3] - gt[1]) * (gt[4] - gt[2]) AS ga, (ps[3] - ps[1]) * (ps[4] - ps[2]) AS pa FROM h),
m AS (SELECT *, CASE WHEN status = 'matched' THEN shared / (ga + pa - shared) END AS iou, CASE WHEN status = 'matched' THEN pa / ga END AS ratio FROM i)"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_BOXES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=shared.spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    return iou.measure(iou.parsed(rows.withColumn("found", F.col("other").isNotNull()), gt_box="bbox", pseudo_box="other"), "found")


@query("WITH " + _IOU + "SELECT row_idx, gt[1] AS x1, gt[2] AS y1, gt[3] AS x2, gt[4] AS y2 FROM m")
def bbox_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select("row_idx", "gt_box.*")


@query("WITH " + _IOU + "SELECT row_idx, status, round(iou, 6) AS iou, round(CASE WHEN status = 'matched' THEN ga END, 6) AS gt_area, round(CASE WHEN status = 'matched' THEN pa END, 6) AS pseudo_area, round(ratio, 6) AS area_ratio FROM m")
def bbox_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_measured(spark, sf_dir).select("row_idx", "status", "iou", "gt_area", "pseudo_area", "area_ratio"), "iou", "gt_area", "pseudo_area", "area_ratio")


def _summary_sql(v: str, p: str) -> str:
    return f"count({v}) AS {p}count, round(avg({v}), 6) AS {p}mean, round(median({v}), 6) AS {p}median, round(stddev_samp({v}), 6) AS {p}stdev, round(min({v}), 6) AS {p}min, round(quantile_cont({v}, 0.25), 6) AS {p}p25, round(quantile_cont({v}, 0.75), 6) AS {p}p75, round(max({v}), 6) AS {p}max"


_RECALL = ", ".join(f"round(avg(CASE WHEN iou IS NOT NULL THEN (iou >= {t}::DOUBLE)::INT END), 6) AS recall_{k}" for t, k in ((0.1, "10"), (0.25, "25"), (0.5, "50"), (0.75, "75")))
_COUNTS = "count(*) AS gt_rows, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}_rows" for s in iou.STATUSES)


@query("WITH " + _IOU + f"SELECT {_COUNTS}, {_summary_sql('iou', 'iou_')}, {_summary_sql('ratio', 'area_ratio_')}, {_RECALL} FROM m")
def iou_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = iou.summarize(_measured(spark, sf_dir))
    return _rounded(out, *[c for c, t in out.dtypes if t == "double"])


@query("WITH " + _IOU + "SELECT l_linenumber, status, count(*) AS n FROM m GROUP BY ALL")
def iou_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).groupBy("l_linenumber", "status").agg(F.count("*").alias("n"))


@query("WITH " + _IOU + "SELECT l_linenumber, row_idx, round(iou, 6) AS iou, (row_number() OVER (PARTITION BY l_linenumber ORDER BY iou, row_idx))::INT AS rank FROM m WHERE status = 'matched' QUALIFY rank <= 10")
def iou_worst_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = iou.worst(_measured(spark, sf_dir), 10, ["l_linenumber"])
    return _rounded(worst.select("l_linenumber", "row_idx", "iou", "rank"), "iou")


@query("WITH " + _IOU + """
, c AS (SELECT row_idx, gt, 60 AS w, 48 AS h, (gt[1] + gt[3]) / 2 AS cx, (gt[2] + gt[4]) / 2 AS cy, greatest((gt[3] - gt[1]) + 2 * ((gt[3] - gt[1]) * 0.15::DOUBLE), 16.0) AS sw, greatest((gt[4] - gt[2]) + 2 * ((gt[4] - gt[2]) * 0.15::DOUBLE), 16.0) AS sh FROM m),
a AS (SELECT *, cx - sw / 2 AS l, cx + sw / 2 AS r, cy - sh / 2 AS t, cy + sh / 2 AS b FROM c),
s AS (SELECT *, CASE WHEN l < 0 THEN r - l ELSE r END AS r1, greatest(l, 0.0) AS l1, CASE WHEN t < 0 THEN b - t ELSE b END AS b1, greatest(t, 0.0) AS t1 FROM a),
z AS (SELECT *, greatest(CASE WHEN r1 > w THEN l1 - (r1 - w) ELSE l1 END, 0.0) AS l2, least(r1, w) AS r2, greatest(CASE WHEN b1 > h THEN t1 - (b1 - h) ELSE t1 END, 0.0) AS t2, least(b1, h) AS b2 FROM s),
f AS (SELECT *, greatest(0, least(w - 1, trunc(l2)::INT)) AS li, greatest(0, least(h - 1, trunc(t2)::INT)) AS ti FROM z)
SELECT row_idx, CASE WHEN gt IS NULL THEN 0 ELSE li END AS "left", CASE WHEN gt IS NULL THEN 0 ELSE ti END AS top,
       CASE WHEN gt IS NULL THEN w ELSE greatest(li + 1, least(w, round_even(r2, 0)::INT)) END AS "right", CASE WHEN gt IS NULL THEN h ELSE greatest(ti + 1, least(h, round_even(b2, 0)::INT)) END AS bottom FROM f""")
def crop_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop = B.padded_crop(F.col("gt_box"), F.lit(60), F.lit(48), 0.15, 16)
    return _measured(spark, sf_dir).select("row_idx", crop.alias("c")).select("row_idx", "c.*")


@query("WITH " + _IOU + "SELECT row_idx, CASE WHEN gt IS NOT NULL THEN printf('%.2f,%.2f,%.2f,%.2f', gt[1] / 3, gt[2] / 3, gt[3] / 3, gt[4] / 3) END AS text FROM m")
def bbox_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = B.box(*[F.col(f"gt_box.{k}") / 3 for k in ("x1", "y1", "x2", "y2")])
    return _measured(spark, sf_dir).select("row_idx", B.format_box(third).alias("text"))


# -- heatmaps ------------------------------------------------------------------------------------------------------

_CELLS = "c AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i)),"


def heatmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_idx, image_path, heatmap (8 x 8), image_width, image_height."""
    f = features(spark, sf_dir)
    return f.select("row_idx", F.concat(F.lit("img/"), "row_idx", F.lit(".png")).alias("image_path"), V.rows_of(F.col("feature"), F.lit(8)).alias("heatmap"), F.lit(64).alias("image_width"), F.lit(48).alias("image_height"))


@query("WITH " + _CELLS + "r AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM c GROUP BY ALL) SELECT vec_id, y::INT AS y, x::INT AS x, round((v - lo) / (hi - lo), 6) + 0.0 AS v FROM c JOIN r USING (vec_id)")
def heatmap_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = features(spark, sf_dir).select(F.col("row_idx").alias("vec_id"), F.posexplode(V.scores_to_grid(F.col("feature"))).alias("y", "row"))
    return grid.select("vec_id", "y", F.posexplode("row").alias("x", "v")).withColumn("v", r6("v"))


@query("WITH " + _CELLS + """s AS (SELECT vec_id, list_sort(list(v)) AS s FROM c GROUP BY ALL),
p AS (SELECT vec_id, arg_max(y * 8 + x, (v, -(y * 8 + x))) AS best FROM c GROUP BY ALL)
SELECT vec_id, round(s[1 + ceil(0.9::DOUBLE * 63)::INT], 6) + 0.0 AS ceil_rule, round(s[greatest(1, floor(0.9::DOUBLE * 64)::INT)], 6) + 0.0 AS count_rule, best::INT AS peak FROM s JOIN p USING (vec_id)""")
def heatmap_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return f.select(F.col("row_idx").alias("vec_id"), r6(G.threshold(F.col("feature"), 0.9)).alias("ceil_rule"), r6(G.threshold_by_count(F.col("feature"), 0.9)).alias("count_rule"), G.peak(F.col("feature")).alias("peak"))


_LABELLED = _CELLS + """
s AS (SELECT vec_id, p, list_sort(list(v))[1 + ceil(p * 63)::INT] AS t FROM c, (VALUES (0.85::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) q(p) GROUP BY vec_id, p),
hot AS (SELECT c.vec_id, p, y, x, v, y * 8 + x AS pos FROM c JOIN s USING (vec_id) WHERE v >= t),
reach AS (SELECT vec_id, p, y, x, pos AS root FROM hot UNION SELECT h.vec_id, h.p, h.y, h.x, r.root FROM reach r JOIN hot h ON h.vec_id = r.vec_id AND h.p = r.p AND abs(h.y - r.y) + abs(h.x - r.x) = 1),
lab AS (SELECT vec_id, p, y, x, min(root) AS root FROM reach GROUP BY ALL),
comp AS (SELECT l.vec_id, l.p, root, count(*)::INT AS area, avg(v) AS score, min(x)::INT AS x1, min(y)::INT AS y1, max(x)::INT AS x2, max(y)::INT AS y2 FROM lab l JOIN c USING (vec_id, y, x) GROUP BY ALL)"""


@query("WITH RECURSIVE " + _LABELLED + "SELECT vec_id, p AS percentile, (row_number() OVER (PARTITION BY vec_id, p ORDER BY root) - 1)::INT AS comp, area, round(score, 6) + 0.0 AS score, x1, y1, x2, y2 FROM comp")
def heatmap_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = regions.component_table(heatmaps(spark, sf_dir), [0.85, 0.9, 0.95], ["row_idx"]).where("not is_peak")
    return t.select(F.col("row_idx").alias("vec_id"), "percentile", "comp", "area", r6("score").alias("score"), *[F.col(f"c{k}").alias(k) for k in ("x1", "y1", "x2", "y2")])


_CHOSEN = """
, g AS (SELECT (row_number() OVER (ORDER BY p, a, k) - 1)::INT AS setting_idx, * FROM (VALUES (0.85::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) q(p), (VALUES (0.0005::DOUBLE), (0.001::DOUBLE), (0.05::DOUBLE)) w(a), (VALUES ('largest'), ('max-score')) z(k)),
cand AS (SELECT g.*, vec_id, root, area, score, x1, y1, x2, y2, 0 AS pk FROM comp JOIN g USING (p) WHERE area >= greatest(1, round_even(64 * a, 0))
         UNION ALL SELECT g.*, vec_id, -1, 1, max(v), (arg_max(y * 8 + x, (v, -(y * 8 + x))) % 8)::INT, (arg_max(y * 8 + x, (v, -(y * 8 + x))) // 8)::INT, (arg_max(y * 8 + x, (v, -(y * 8 + x))) % 8)::INT, (arg_max(y * 8 + x, (v, -(y * 8 + x))) // 8)::INT, 1 FROM c, g GROUP BY ALL),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY vec_id, setting_idx ORDER BY pk, CASE WHEN k = 'largest' THEN area ELSE score END DESC, CASE WHEN k = 'largest' THEN score ELSE area END DESC, root) = 1),
bx AS (SELECT *, x1 * 8.0 AS bx1, y1 * 6.0 AS by1, least(64.0, (x2 + 1) * 8.0) AS bx2, least(48.0, (y2 + 1) * 6.0) AS by2 FROM best)"""


@query("WITH RECURSIVE " + _LABELLED + _CHOSEN + "SELECT vec_id, setting_idx, area, round(score, 6) + 0.0 AS score, bx1::DOUBLE AS x1, by1::DOUBLE AS y1, bx2::DOUBLE AS x2, by2::DOUBLE AS y2 FROM bx")
def heatmap_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = [0.85, 0.9, 0.95]
    settings = regions.settings_table(spark, ps, [0.0005, 0.001, 0.05], ["largest", "max-score"])
    chosen = regions.choose(regions.component_table(heatmaps(spark, sf_dir), ps, ["row_idx"]), ["row_idx"], settings)
    return chosen.select(F.col("row_idx").alias("vec_id"), "setting_idx", "area", r6("score").alias("score"), "box.*")


@query("WITH RECURSIVE " + _LABELLED + """
, kept AS (SELECT * FROM comp WHERE p = 0.9::DOUBLE AND area >= 2),
cells AS (SELECT l.vec_id, l.y, l.x, c.v FROM lab l JOIN kept k ON k.vec_id = l.vec_id AND k.p = l.p AND k.root = l.root JOIN c ON c.vec_id = l.vec_id AND c.y = l.y AND c.x = l.x
          UNION ALL SELECT vec_id, arg_max(y * 8 + x, (v, -(y * 8 + x))) // 8, arg_max(y * 8 + x, (v, -(y * 8 + x))) % 8, max(v) FROM c WHERE vec_id NOT IN (SELECT vec_id FROM kept) GROUP BY vec_id)
SELECT vec_id, (count(*) * 48)::INT AS area, round(avg(v), 6) + 0.0 AS score, (min(x) * 8)::DOUBLE AS x1, (min(y) * 6)::DOUBLE AS y1, ((max(x) + 1) * 8)::DOUBLE AS x2, ((max(y) + 1) * 6)::DOUBLE AS y2 FROM cells GROUP BY ALL""")
def heatmap_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = regions.heatmap_masks(heatmaps(spark, sf_dir), ["row_idx"], 0.9, 0.03, "all")
    return m.select(F.col("row_idx").alias("vec_id"), "area", r6("score").alias("score"), "box.*")


@query("WITH " + _CELLS + """s AS (SELECT vec_id, list_sort(list(v)) AS s FROM c GROUP BY ALL), t AS (SELECT vec_id, s[greatest(1, floor(0.95::DOUBLE * 64)::INT)] AS t, s[64] AS hi FROM s),
n AS (SELECT vec_id, count(*) FILTER (v >= t) AS n FROM c JOIN t USING (vec_id) GROUP BY ALL)
SELECT vec_id, round(CASE WHEN n < 5 THEN hi ELSE t END, 6) + 0.0 AS threshold, count(*)::INT AS area, round(avg(v), 6) + 0.0 AS confidence FROM c JOIN t USING (vec_id) JOIN n USING (vec_id) WHERE v >= CASE WHEN n < 5 THEN hi ELSE t END GROUP BY vec_id, n, hi, t""")
def pseudo_mask_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = heatmaps(spark, sf_dir).select(F.col("row_idx").alias("vec_id"), G.simple_mask(F.col("heatmap"), 0.95, 5).alias("m"))
    return m.select("vec_id", r6("m.threshold").alias("threshold"), "m.area", r6("m.confidence").alias("confidence"))


@query("WITH " + _CELLS + """
ax AS (SELECT t, greatest(0, least(7, floor((t + 0.5) * 8 / 16.0 - 0.5)))::INT AS a, (t + 0.5) * 8 / 16.0::DOUBLE - 0.5 AS s FROM range(16) r(t)),
ay AS (SELECT t, greatest(0, least(7, floor((t + 0.5) * 8 / 12.0 - 0.5)))::INT AS a, (t + 0.5) * 8 / 12.0::DOUBLE - 0.5 AS s FROM range(12) r(t)),
wx AS (SELECT t, a, least(7, a + 1) AS b, CASE WHEN s < 0 THEN 0 ELSE s - a END::DOUBLE AS w FROM ax), wy AS (SELECT t, a, least(7, a + 1) AS b, CASE WHEN s < 0 THEN 0 ELSE s - a END::DOUBLE AS w FROM ay),
g AS (SELECT vec_id, embedding AS e FROM embeddings)
SELECT vec_id, wy.t::INT AS y, wx.t::INT AS x, round((e[wy.a * 8 + wx.a + 1]::DOUBLE * (1 - wx.w) + e[wy.a * 8 + wx.b + 1]::DOUBLE * wx.w) * (1 - wy.w) + (e[wy.b * 8 + wx.a + 1]::DOUBLE * (1 - wx.w) + e[wy.b * 8 + wx.b + 1]::DOUBLE * wx.w) * wy.w, 6) + 0.0 AS v FROM g, wx, wy""".replace("c AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i)),", ""))
def heatmap_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = heatmaps(spark, sf_dir).select(F.col("row_idx").alias("vec_id"), F.posexplode(G.resize_bilinear(F.col("heatmap"), F.lit(16), F.lit(12))).alias("y", "row"))
    return rows.select("vec_id", "y", F.posexplode("row").alias("x", "v")).withColumn("v", r6("v"))


@query("WITH " + _CELLS + """m AS (SELECT vec_id, y, x FROM c WHERE v >= 0.2), t AS (SELECT a.t AS ty, b.t AS tx, least(7, a.t * 8 // 13) AS y, least(7, b.t * 8 // 19) AS x FROM range(13) a(t), range(19) b(t))
SELECT v.vec_id, count(m.vec_id)::INT AS area FROM (SELECT vec_id FROM embeddings) v CROSS JOIN t LEFT JOIN m ON m.vec_id = v.vec_id AND m.y = t.y AND m.x = t.x GROUP BY ALL""")
def mask_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = G.above(F.col("heatmap"), F.lit(0.2))
    return heatmaps(spark, sf_dir).select(F.col("row_idx").alias("vec_id"), G.mask_area(G.resize_nearest(mask, F.lit(19), F.lit(13))).alias("area"))


_GT = "CASE WHEN vec_id % 17 = 0 THEN NULL ELSE [(vec_id % 40)::DOUBLE, (vec_id % 30)::DOUBLE, (vec_id % 40 + 20)::DOUBLE, (vec_id % 30 + 16)::DOUBLE] END"


@query("WITH RECURSIVE " + _LABELLED + _CHOSEN + f"""
, gt AS (SELECT vec_id, {_GT} AS g FROM embeddings),
i AS (SELECT bx.*, g, CASE WHEN g IS NULL THEN 'invalid_gt_bbox' ELSE 'matched' END AS status, greatest(0.0::DOUBLE, least(g[3], bx2) - greatest(g[1], bx1)) * greatest(0.0::DOUBLE, least(g[4], by2) - greatest(g[2], by1)) AS shared,
      (g[3] - g[1]) * (g[4] - g[2]) AS ga, (bx2 - bx1) * (by2 - by1) AS pa FROM bx JOIN gt USING (vec_id)),
m AS (SELECT *, shared / (ga + pa - shared) AS iou, pa / ga AS ratio FROM i),
su AS (SELECT setting_idx, p, a, k, count(iou) AS n, avg(iou) AS mean, median(iou) AS med, avg((iou >= 0.25::DOUBLE)::INT) AS r25, avg((iou >= 0.5::DOUBLE)::INT) AS r50, avg(ratio) AS ra FROM m GROUP BY ALL)
SELECT (row_number() OVER (ORDER BY round(mean, 9) DESC, round(r50, 9) DESC, round(r25, 9) DESC, round(med, 9) DESC, setting_idx))::INT AS rank, setting_idx, p AS percentile, a AS min_area_ratio, k AS component, n AS evaluated,
       round(mean, 6) AS iou_mean, round(med, 6) AS iou_median, round(r25, 6) AS recall_25, round(r50, 6) AS recall_50, round(ra, 6) AS area_ratio_mean FROM su""")
def bbox_sweep_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = heatmaps(spark, sf_dir)
    vec = F.col("row_idx")
    corner = lambda n, add: (vec % n + add).cast("string")
    box = F.when(vec % 17 == 0, "").otherwise(F.concat_ws(",", corner(40, 0), corner(30, 0), corner(40, 20), corner(30, 16)))
    manifest = maps.select("row_idx", "image_path", box.alias("bbox"))
    ranked, _ = evaluation.box_sweep(manifest, maps.drop("row_idx"), ratios=(0.0005, 0.001, 0.05))
    # sums differ in the last bits between engines: ranks compare nine decimals
    nine = ranked.drop("rank").withColumns({c: F.round(c, 9) for c in ("iou_mean", "recall_50", "recall_25", "iou_median")})
    out = iou.rank(nine).select("rank", "setting_idx", "percentile", "min_area_ratio", "component", F.col("iou_count").alias("evaluated"), "iou_mean", "iou_median", "recall_25", "recall_50", "area_ratio_mean")
    return _rounded(out, "iou_mean", "iou_median", "recall_25", "recall_50", "area_ratio_mean")


def _merged(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    rows = heatmaps(spark, sf_dir).withColumn("image_path", F.concat(F.lit("img/"), F.col("row_idx") % 100))
    m = merge.merge_duplicates(rows, policy)
    flat = F.flatten("heatmap")
    return m.select("image_path", "duplicate_count", "first_row", r6(V.total(flat)).alias("plain_sum"), r6(V.total(F.transform(flat, lambda x, i: x * (i + 1)))).alias("place_sum"))


def _merge_sql(value: str) -> str:
    return f"""WITH d AS (SELECT 'img/' || (vec_id % 100) AS image_path, count(*) AS duplicate_count, min(vec_id) AS first_row, min(vec_id) AS lo, max(vec_id) AS hi FROM embeddings GROUP BY 1),
e AS (SELECT 'img/' || (vec_id % 100) AS image_path, vec_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) t(i)),
v AS (SELECT image_path, i, {value} AS v FROM e JOIN d USING (image_path) GROUP BY ALL)
SELECT image_path, duplicate_count, first_row, round(sum(v), 6) + 0.0 AS plain_sum, round(sum(v * (i + 1)), 6) + 0.0 AS place_sum FROM v JOIN d USING (image_path) GROUP BY ALL"""


@query(_merge_sql("max(x)"))
def heatmap_dedupe_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "max")


@query(_merge_sql("arg_min(x, vec_id)"))
def heatmap_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "first")


@query(_merge_sql("arg_max(x, vec_id)"))
def heatmap_dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "last")


_LINES = """
SELECT event_id AS row_idx, user_id % 50 AS img, CASE
  WHEN event_id % 19 = 0 THEN '' WHEN event_id % 23 = 0 THEN '{{oops' WHEN event_id % 29 = 0 THEN '[1]'
  WHEN event_id % 31 = 0 THEN '{{"heatmap": [[1]]}}' WHEN event_id % 37 = 0 THEN '{{"image_path": "a", "heatmap": []}}'
  WHEN event_id % 41 = 0 THEN '{{"image_path": "a", "heatmap": [[1, 2], [3]]}}' WHEN event_id % 43 = 0 THEN '{{"image_path": "a", "heatmap": [[1, true]]}}'
  WHEN event_id % 47 = 0 THEN '{{"image_path": "a", "heatmap": [[1, 2]], "heatmap_width": 3}}' WHEN event_id % 53 = 0 THEN '{{"image_path": "a", "heatmap": [[1]], "image_width": -1}}'
  WHEN event_id % 59 = 0 THEN '{{"image_path": "a", "heatmap": [[1]], "image_width": 9}}'
  ELSE '{{"image_path": " img\\\\\\\\' || (user_id % 50) || ' ", "heatmap": [[1, 2], [3, 4.5]], "image_width": "9.0", "image_height": 9}}' END AS value
FROM {events}"""


@query("""
WITH c AS (SELECT event_id AS row_idx, user_id % 50 AS img, CASE WHEN event_id % 19 = 0 THEN 'blank' WHEN event_id % 23 = 0 THEN 'invalid_json' WHEN event_id % 29 = 0 THEN 'not_an_object'
  WHEN event_id % 31 = 0 THEN 'missing_image_path' WHEN event_id % 37 = 0 THEN 'empty_heatmap' WHEN event_id % 41 = 0 THEN 'ragged_rows' WHEN event_id % 43 = 0 THEN 'not_finite_numeric'
  WHEN event_id % 47 = 0 THEN 'heatmap_width_mismatch' WHEN event_id % 53 = 0 THEN 'bad_image_width' WHEN event_id % 59 = 0 THEN 'missing_image_size' END AS error FROM events),
d AS (SELECT *, CASE WHEN error IS NULL AND row_number() OVER (PARTITION BY img, error IS NULL ORDER BY row_idx) > 1 THEN 'duplicate_image_path' ELSE error END AS e FROM c WHERE error IS DISTINCT FROM 'blank')
SELECT coalesce(e, 'ok') AS error, count(*) AS n, min(row_idx) AS first_row FROM d GROUP BY ALL""")
def heatmap_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(_LINES, events=shared.spread(table(spark, sf_dir, "events").select("event_id", "user_id"))).select("row_idx", "value")
    checked = validate.with_duplicates(validate.report(lines), "error")
    return checked.groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"), F.min("row_idx").alias("first_row"))


# -- keys, paths, policies -----------------------------------------------------------------------------------------


@query("SELECT 'missing' AS side, doc_id::VARCHAR AS key FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'extra', doc_id::VARCHAR FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def heatmap_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda t: table(spark, sf_dir, t).select(F.concat(F.lit("  "), F.col("doc_id")).alias("image_path"))
    missing, extra = merge.missing_and_extra(key("documents"), key("labels"))
    return missing.select(F.lit("missing").alias("side"), F.col("image_path").alias("key")).unionByName(extra.select(F.lit("extra").alias("side"), F.col("image_path").alias("key")))


@query("(SELECT o_custkey + 10 AS k FROM orders EXCEPT SELECT c_custkey FROM customer) UNION ALL (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey + 10 FROM orders)")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.symmetric_difference(table(spark, sf_dir, "orders").select((F.col("o_custkey") + 10).alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id % 7 END AS value, page_id % 3 <> 0 AS found FROM pages")
def key_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe paths have back slashes; the table has either form, or lacks the path."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    path = lambda sep: F.concat(F.lit(f"a{sep}b{sep}"), F.col("page_id"))
    probe = pages.select("page_id", path("\\").alias("image_path"))
    stored = pages.where("page_id % 3 <> 0").select(F.when(F.col("page_id") % 3 == 1, path("\\")).otherwise(path("/")).alias("image_path"), (F.col("page_id") % 7).alias("value"))
    return merge.lookup(probe, stored, "image_path", ["value"]).select("page_id", "value", "found")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '' ELSE lang END AS bbox, CASE WHEN l.doc_id IS NULL THEN 'missing_heatmap_clear' ELSE 'pseudo' END AS bbox_source FROM documents d LEFT JOIN labels l USING (doc_id)")
def missing_policy_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, "clear")


@query("SELECT d.doc_id, lang AS bbox, CASE WHEN l.doc_id IS NULL THEN 'missing_heatmap_keep' ELSE 'pseudo' END AS bbox_source FROM documents d LEFT JOIN labels l USING (doc_id)")
def missing_policy_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, "keep")


def _policy(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("hit"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", F.col("lang").alias("bbox"), F.lit("pseudo").alias("bbox_source"), F.col("hit").isNotNull().alias("found"))
    return merge.fill_missing(rows, ["bbox"], policy).drop("found")


_PATHS = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'bottle/Train/hole/' WHEN 1 THEN 'cable/valid/' WHEN 2 THEN 'screw/top view/' WHEN 3 THEN '' ELSE 'testing/a b/c/' END || page_id || '.png' AS p FROM pages"""


@query("WITH t AS (" + _PATHS + """)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 4 THEN 'test' END AS split, CASE page_id % 5 WHEN 0 THEN 'bottle' WHEN 1 THEN 'cable' WHEN 2 THEN 'screw' WHEN 3 THEN 'unknown_object' ELSE 'testing' END AS object_name,
       CASE page_id % 5 WHEN 0 THEN 'hole' WHEN 1 THEN 'valid' WHEN 2 THEN 'top_view' WHEN 3 THEN 'root' ELSE 'a_b' END AS defect_name FROM t""")
def manifest_path_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.sql(_PATHS.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))
    c = F.col("p")
    return p.select("page_id", P.infer_split(c).alias("split"), P.infer_object(c).alias("object_name"), P.infer_defect(c, root_name="root").alias("defect_name"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'unknown_defect' ELSE replace(replace(p_type, ' ', '_'), '/', '_') || '_x' END AS label, replace(p_type, ' ', '/') || '/' || p_partkey AS path FROM part")
def label_and_path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 11 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit(" "), "p_type", F.lit("/x\n")))
    path = F.concat(F.lit(" "), F.replace("p_type", F.lit(" "), F.lit("\\")), F.lit("\\"), "p_partkey", F.lit("\t"))
    return table(spark, sf_dir, "part").select("p_partkey", P.normalize_label(raw).alias("label"), P.normalize_path(path).alias("path"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'masks/' || lang || '/' || doc_id || '.png' ELSE 'masks/C' || lang || '__' || doc_id || '.jpg.png' END AS path FROM documents")
def mask_output_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("\\"), "doc_id", F.lit(".jpg"))).otherwise(F.concat(F.lit("/C:"), "lang", F.lit("/"), "doc_id", F.lit(".jpg")))
    return table(spark, sf_dir, "documents").select("doc_id", P.mask_path("masks", image).alias("path"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


from . import file_queries  # noqa: E402, F401  registers its queries here
