"""Column functions on hand-computed values, with NaN, infinities, ties and empty arrays."""

import math

import pytest
from pyspark.sql import functions as F

from glyphflow.functions import display, geometry, reading
from glyphflow.operators import detect

FLOATS = "array<float>"


def one(spark, column, values=(), schema="x int"):
    df = spark.createDataFrame([values or (0,)], schema)
    return df.select((column if not isinstance(column, str) else F.expr(column)).alias("r")).first().r


@pytest.mark.parametrize(
    ("w", "h", "target", "dst"),
    [(100, 50, 100, (96, 32)), (64, 64, 64, (64, 64)), (4000, 1, 1124, (1120, 0)), (1, 4000, 1124, (0, 1120)), (30, 30, 30, (32, 32)), (333, 777, 1124, (480, 1120))],
)
def test_scale(spark, w, h, target, dst):
    r = one(spark, geometry.scale_param(str(w), str(h), str(target)))
    assert (r.dst_w, r.dst_h) == dst
    s = detect.scale_of(w, h, target)
    assert (s.dst_w, s.dst_h, float(s.scale_w), float(s.scale_h)) == (r.dst_w, r.dst_h, r.scale_w, r.scale_h)


def test_target_side(spark):
    for w, h, most, pad, expected in ((10, 20, 0, 5, 30), (10, 20, 1024, 50, 120), (2000, 20, 1024, 50, 1124)):
        assert one(spark, geometry.target_side(str(w), str(h), most, pad)) == expected


@pytest.mark.parametrize(
    ("scores", "expected"),
    [([0.2, 0.8], (1, 0.8)), ([0.8, 0.2], (0, 0.8)), ([0.5, 0.5], (0, 0.5)), ([math.nan, 1.0], (0, math.nan)), ([0.1, math.nan], (0, 0.1)), ([], (0, -3.4028234663852886e38)), ([0.3], (0, 0.3)), ([0.1, 0.2, 9.0], (1, 0.2)), ([-math.inf, -1.0], (1, -1.0))],
)
def test_angle(spark, scores, expected):
    r = one(spark, reading.angle("x"), (scores,), f"x {FLOATS}")
    i, s = detect.first_angle(__import__("numpy").array(scores, "f4"))
    assert r["index"] == expected[0] == i
    assert r["score"] == pytest.approx(expected[1], nan_ok=True) and float(s) == pytest.approx(expected[1], nan_ok=True)


@pytest.mark.parametrize(("votes", "index"), [([1, 0], 1), ([1, 0, 0], 0), ([1, 1, 0], 1), ([0], 0), ([], None)])
def test_majority(spark, votes, index):
    r = one(spark, reading.most_angle("x"), ([(v, 0.25) for v in votes],), "x array<struct<index:int,score:float>>")
    assert [(a["index"], a["score"]) for a in r] == [(index, 0.25)] * len(votes)


KEYS = ["#", "a", "b", "c", " "]
N = math.nan


@pytest.mark.parametrize(
    ("steps", "text", "score"),
    [
        ([[0, 1, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0]], "a", 1.0),
        ([[0, 1, 0, 0, 0, 0], [1, 0, 0, 0, 0, 0], [0, 0.5, 0, 0, 0, 0]], "aa", 0.75),
        ([[0, 0.9, 0, 0, 0, 0], [0, 0, 0, 0, 0, 1], [0, 0.9, 0, 0, 0, 0]], "aa", 0.9),
        ([[0, 0, 0, 0, 0, 1], [0, 0, 0, 0, 0, 1]], "", 0.0),
        ([[N, 0.5, N, 0.4, 0, 0]], "a", 0.5),
        ([[N] * 6, [0, 0, 0.25, 0, 0.25, 0]], "b", 0.25),
        ([[0, 0, 0, 0, 1, 0]], " ", 1.0),
        ([], "", 0.0),
    ],
)
def test_decoding(spark, steps, text, score):
    import numpy as np

    r = one(spark, reading.decoded("x", "k"), ([[float(v) for v in s] for s in steps], KEYS), f"x array<{FLOATS}>, k array<string>")
    assert (r.text, r.text_score) == (text, pytest.approx(score))
    if steps:
        t, s = detect.text_of(np.array(steps, "f4"), KEYS)
        assert (t, float(s)) == (text, pytest.approx(score))


def test_key_lists(spark):
    text = "x\r\n\ny\n"
    assert one(spark, reading.keys_of_metadata(F.col("x")), (text,), "x string") == ["#", "x\r", "", "y", "", " "]
    assert one(spark, reading.keys_of_file(F.col("x")), (text,), "x string") == ["#", "x\r", "y", " "]


@pytest.mark.parametrize(("score", "threshold", "turned", "again"), [(0.5, 0.8, True, True), (0.5, 0.8, False, False), (0.8, 0.8, True, False), (N, 0.1, True, True)])
def test_rollback(spark, score, threshold, turned, again):
    assert one(spark, reading.rolled_back("x", threshold, str(turned)), (score,), "x float") is again


def test_quantised(spark):
    values = [N, -1.0, 0.0, 0.3, 0.999, 1.0, 7.0, math.inf, -math.inf]
    got = one(spark, f"transform(x, p -> {geometry.quantised('p')})", (values,), f"x {FLOATS}")
    assert got == [0, 0, 0, 76, 254, 255, 255, 255, 0] == detect.quantised(__import__("numpy").array(values, "f4")).tolist()


def test_rescaled_points_saturate(spark):
    s = "named_struct('scale_w', CAST(0.5 AS FLOAT), 'scale_h', CAST(0 AS FLOAT), 'src_w', 9L, 'src_h', 7L)"
    p = "array(named_struct('x', CAST(-3 AS FLOAT), 'y', CAST(1 AS FLOAT)), named_struct('x', CAST(2.9 AS FLOAT), 'y', CAST(1 AS FLOAT)), named_struct('x', CAST('NaN' AS FLOAT), 'y', CAST('NaN' AS FLOAT)))"
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one(spark, geometry.rescaled(p, s))
    got = one(spark, geometry.rescaled(p, s.replace("CAST(0 AS FLOAT)", "CAST(0.1 AS FLOAT)")))
    assert [tuple(x) for x in got] == [(0, 7), (5, 7), (0, 0)]


@pytest.mark.parametrize(
    ("x", "shown"),
    [(1.0, "1"), (0.5, "0.5"), (0.95269924, "0.95269924"), (N, "NaN"), (math.inf, "inf"), (-math.inf, "-inf"), (1e10, "10000000000"), (-2.5e-7, "-0.00000025"), (0.0, "0"), (16777216.0, "16777216"), (-3.4028235e38, "-34028235" + "0" * 31)],
)
def test_numbers_shown(spark, x, shown):
    assert one(spark, display.number("x"), (x,), "x float") == shown


def test_texts_shown(spark):
    box = "named_struct('points', array(" + ", ".join(f"named_struct('x', {i}, 'y', {i + 1})" for i in range(4)) + "), 'score', CAST(0.5 AS FLOAT))"
    assert one(spark, display.box_text(box)) == "TextBox [score(0.5), [x: 0, y: 1], [x: 1, y: 2], [x: 2, y: 3], [x: 3, y: 4]]"
    assert one(spark, display.angle_text("named_struct('index', -1, 'score', CAST(0 AS FLOAT))")) == "AngleDisabled[Index(-1), Score(0)]"
    assert one(spark, display.line_text("named_struct('text', 'ab', 'text_score', CAST(1 AS FLOAT))")) == "TextLine[Text(ab),TextScore(1)]"
    assert one(spark, display.scale_text("named_struct('src_w', 1, 'src_h', 2, 'dst_w', 3, 'dst_h', 4, 'scale_w', CAST(3 AS FLOAT), 'scale_h', CAST(2 AS FLOAT))")) == "src_width:1,src_height:2,dst_width:3,dst_height:4,scale_width:3,scale_height:2"


def test_small_boxes_have_no_distance(spark):
    p = "array(named_struct('x', 0, 'y', 0), named_struct('x', 1, 'y', 0), named_struct('x', 1, 'y', 1), named_struct('x', 0, 'y', 1))"
    assert one(spark, geometry.offset_distance(p, 1.6)) is None
    assert one(spark, geometry.perimeter("CAST(array() AS array<struct<x:int,y:int>>)")) == 0.0
