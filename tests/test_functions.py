import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionloom.functions import boxes as B
from regionloom.functions import grids as G
from regionloom.functions import paths as P
from regionloom.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def vec(values):
    return F.array(*[F.lit(float(v)) for v in values])


def grid(rows):
    return F.array(*[vec(r) for r in rows])


def test_vectors(spark):
    assert one(spark, V.parse_vector(F.lit("[1, 2.5]"))) == [1, 2.5]
    assert one(spark, V.parse_vector(F.lit("1, 2.5  3"))) == [1, 2.5, 3]
    assert one(spark, V.parse_spaced(F.lit("  1   2 "))) == [1, 2]
    assert one(spark, V.l2_normalize(vec([3, 4]))) == [0.6, 0.8]
    assert one(spark, V.l2_normalize(vec([0, 0]))) == [0, 0]
    assert one(spark, V.fuse(vec([1, 2]), vec([3, 4]))) == [1, 2, 3, 4]
    assert one(spark, V.fuse(vec([1, 0]), vec([0, 1]), "weighted-sum", 0.25)) == [0.25, 0.75]
    assert one(spark, V.min_max(vec([2, 4, 6]))) == [0, 0.5, 1]
    assert one(spark, V.min_max(vec([3, 3]))) == [0, 0]
    assert one(spark, V.scores_to_grid(vec([0, 1, 2, 3]))) == [[0, 1 / 3], [2 / 3, 1]]


@pytest.mark.parametrize("column", [V.scores_to_grid(vec([0, 1, 2])) if False else None], ids=["square"])
def test_errors(spark, column):
    with pytest.raises(Exception, match="no square grid"):
        one(spark, V.scores_to_grid(vec([0, 1, 2])))
    with pytest.raises(Exception, match="lengths differ"):
        one(spark, V.dot(vec([1]), vec([1, 2])))
    with pytest.raises(Exception, match="one length"):
        one(spark, V.fuse(vec([1]), vec([1, 2]), "weighted-sum"))
    with pytest.raises(ValueError):
        V.fuse(F.lit(1), F.lit(1), "weighted-sum", 1.5)


def test_boxes(spark):
    box = lambda t: B.parse_box(F.lit(t))
    assert tuple(one(spark, box("0,0,10,10"))) == (0, 0, 10, 10)
    assert tuple(one(spark, box(" 1; 2 ;17,25.5"))) == (1, 2, 17, 25.5)
    assert [one(spark, box(t)) for t in ("", "  ", "0,0,0,10", "1,2,3", "1,2,x,4", None)] == [None] * 6
    a = box("0,0,10,10")
    assert one(spark, B.iou(a, a)) == 1
    assert one(spark, B.iou(a, box("10,10,20,20"))) == 0
    assert round(one(spark, B.iou(a, box("5,5,15,15"))), 4) == 0.1429
    assert one(spark, B.parse_box_strict(F.lit(" "))) is None
    with pytest.raises(Exception, match="no box"):
        one(spark, B.parse_box_strict(F.lit("1,2")))
    values = [2.675, 0.125, 1.005, 3.0]
    assert one(spark, B.format_box(B.box(*values))) == ",".join(f"{v:.2f}" for v in values)


def test_crop(spark):
    crop = lambda t, w, h, p, m: tuple(one(spark, B.padded_crop(B.parse_box(F.lit(t)), F.lit(w), F.lit(h), p, m)))
    assert crop("10,20,30,50", 100, 100, 0.1, 1) == (8, 17, 32, 53)
    assert crop("0,0,5,5", 20, 20, 0.2, 10) == (0, 0, 10, 10)
    assert crop("", 64, 48, 0.1, 1) == (0, 0, 64, 48)


def test_paths(spark):
    rows = spark.createDataFrame([("bottle/train/hole/1.png",), ("cable/1.png",), ("1.png",), ("x/Valid/1.png",), ("a/b c/d.png",)], "p string")
    got = rows.select(P.infer_split(F.col("p")), P.infer_object(F.col("p")), P.infer_defect(F.col("p"), root_name="root")).collect()
    assert [tuple(r) for r in got] == [("train", "bottle", "hole"), (None, "cable", "cable"), (None, "unknown_object", "root"), ("val", "x", "Valid"), (None, "a", "b_c")]
    assert one(spark, P.normalize_label(F.lit(" a b/c "))) == "a_b_c"
    assert one(spark, P.normalize_label(F.lit("  "))) == "unknown_defect"
    assert one(spark, P.normalize_path(F.lit(" a\\b\t"))) == "a/b"
    assert one(spark, P.mask_path("m", F.lit("a\\b.jpg"))) == "m/a/b.png"
    assert one(spark, P.mask_path("m", F.lit("/x/C:y/b.jpg"))) == "m/x__Cy__b.jpg.png"


def test_thresholds(spark):
    values = [float(v) for v in range(16)]
    random.Random(1).shuffle(values)
    assert one(spark, G.threshold(vec(values), 0.75)) == 12
    assert one(spark, G.threshold_by_count(vec(values), 0.9)) == 13
    assert one(spark, G.peak(vec([0, 3, 3, 1]))) == 1


def test_resize(spark):
    out = one(spark, G.resize_bilinear(grid([[0, 0], [0, 1]]), F.lit(4), F.lit(4)))
    assert out[0][0] == 0 and out[3][3] == 1 and out[2][2] == 0.5625
    from regionloom.operators.regions import bilinear, nearest

    rng = np.random.default_rng(3)
    g = rng.random((5, 7))
    got = one(spark, G.resize_bilinear(grid(g.tolist()), F.lit(11), F.lit(4)))
    assert np.allclose(got, bilinear(g, 11, 4))
    mask = g > 0.5
    column = F.array(*[F.array(*[F.lit(bool(v)) for v in r]) for r in mask])
    assert one(spark, G.resize_nearest(column, F.lit(9), F.lit(8))) == nearest(mask, 9, 8).tolist()
    assert tuple(one(spark, G.tight_box(column))) == (mask.any(0).nonzero()[0].min(), mask.any(1).nonzero()[0].min(), mask.any(0).nonzero()[0].max() + 1, mask.any(1).nonzero()[0].max() + 1)


def test_simple_mask(spark):
    m = one(spark, G.simple_mask(grid([[0.1, 0.9], [0.2, 0.9]]), 1.0, 3))
    assert m["area"] == 2 and m["threshold"] == 0.9 and m["values"] == [[False, True], [False, True]] and round(m["confidence"], 9) == 0.9


def test_rectangles(spark):
    rows = spark.createDataFrame([([[1.0, 2.0]],), ([],), ([[1.0], [1.0, 2.0]],), ([[float("nan")]],), (None,)], "h array<array<double>>")
    assert [r[0] for r in rows.select(G.is_rectangular(F.col("h"))).collect()] == [True, False, False, False, False]
