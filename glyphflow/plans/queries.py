"""The queries of the image-text dataflow over the driver's tables, with SQL for each.

The tables hold no pictures: sizes, boxes, scores and maps are made from their columns by fixed rules, over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphflow.functions import display, geometry, reading
from glyphflow.functions.f32 import f
from glyphflow.operators import contours, detect
from glyphflow.plans.pipeline import OcrPipeline, assembled, text_blocks
from glyphflow.schema import IMAGE, OcrOptions
from glyphflow.sources import standin
from glyphflow.sources.images import struct_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: One key short of the eight classes, so that the last class is beyond the keys.
KEYS = ["#", "a", "b", "c", "d", "e", "f"]
SIZES = ("1 + (l_orderkey * 37) % 4000 AS w", "1 + (l_partkey * 53) % 3000 AS h")
MAP = "transform(embedding, v -> CAST(v + CAST(0.5 AS FLOAT) AS FLOAT))"
#: Four corners, with equal x often; in SQL of either engine.
CORNERS = (("(l_orderkey * 7) % 50", "(l_partkey * 3) % 90"), ("60 + (l_orderkey * 11) % 50", "(l_suppkey * 5) % 90"), ("60 + (l_partkey * 13) % 50", "100 + (l_orderkey * 3) % 90"), ("(l_suppkey * 17) % 50", "100 + (l_partkey * 7) % 90"))


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(kind: str = "BIGINT") -> str:
    return "array(" + ", ".join(f"named_struct('x', CAST({x} AS {kind}), 'y', CAST({y} AS {kind}))" for x, y in CORNERS) + ")"


def corner_columns(name: str) -> list:
    return [F.col(name)[i][a].cast("long").alias(f"{a}{i}") for i in range(4) for a in ("x", "y")]


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, 1 + (l_orderkey * 37) % 4000 AS w, 1 + (l_partkey * 53) % 3000 AS h FROM lineitem),
t AS (SELECT *, least(1024, greatest(w, h)) + 100 AS target FROM s),
r AS (SELECT *, CASE WHEN w > h THEN (target::FLOAT / w::FLOAT)::FLOAT ELSE (target::FLOAT / h::FLOAT)::FLOAT END AS ratio FROM t),
d AS (SELECT *, trunc((w::FLOAT * ratio)::FLOAT)::BIGINT AS dw, trunc((h::FLOAT * ratio)::FLOAT)::BIGINT AS dh FROM r),
e AS (SELECT *, CASE WHEN dw % 32 = 0 THEN dw ELSE greatest(32, dw // 32 * 32) END AS dst_w, CASE WHEN dh % 32 = 0 THEN dh ELSE greatest(32, dh // 32 * 32) END AS dst_h FROM d)
SELECT l_orderkey, l_linenumber, target::BIGINT AS target, dst_w::BIGINT AS dst_w, dst_h::BIGINT AS dst_h, (dst_w::FLOAT / w::FLOAT)::FLOAT AS scale_w, (dst_h::FLOAT / h::FLOAT)::FLOAT AS scale_h FROM e
""")
def scale_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *SIZES).withColumn("target", F.expr(geometry.target_side("w", "h", 1024, 50)).cast("long"))
    return d.withColumn("s", geometry.scale_param("w", "h", "target")).select("l_orderkey", "l_linenumber", "target", "s.dst_w", "s.dst_h", "s.scale_w", "s.scale_h")


CTC_SQL = """
WITH s AS (SELECT vec_id, t, embedding[t * 8 + 1 : t * 8 + 8] AS v FROM embeddings, range(8) r(t)),
b AS (SELECT vec_id, t, list_max(v) AS m, list_position(v, list_max(v)) - 1 AS i FROM s),
p AS (SELECT *, lag(i) OVER (PARTITION BY vec_id ORDER BY t) AS last FROM b),
e AS (SELECT * FROM p WHERE i > 0 AND i < 7 AND (last IS NULL OR i <> last)),
g AS (SELECT vec_id, string_agg(['#','a','b','c','d','e','f'][i + 1], '' ORDER BY t) AS text, list(m ORDER BY t) AS ms FROM e GROUP BY vec_id)
SELECT v.vec_id, coalesce(text, '') AS text, CASE WHEN ms IS NULL THEN 0::FLOAT ELSE (list_reduce(list_prepend(0::FLOAT, ms), lambda a, x: (a + x)::FLOAT)::FLOAT / len(ms)::FLOAT)::FLOAT END AS text_score
FROM (SELECT DISTINCT vec_id FROM embeddings) v LEFT JOIN g USING (vec_id)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = "transform(sequence(0, 7), t -> slice(embedding, t * 8 + 1, 8))"
    keys = "array(" + ", ".join(f"'{k}'" for k in KEYS) + ")"
    d = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.expr(steps).alias("steps"), F.expr(keys).alias("keys"))
    return d.withColumn("line", reading.decoded("steps", "keys"))


@query(CTC_SQL)
def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("vec_id", "line.text", "line.text_score")


@query("""
WITH a AS (SELECT vec_id, CASE WHEN embedding[2] > embedding[1] THEN 1 ELSE 0 END AS i, CASE WHEN embedding[2] > embedding[1] THEN embedding[2] ELSE embedding[1] END AS score FROM embeddings)
SELECT vec_id, i::INT AS own_index, CASE WHEN sum(i) OVER (PARTITION BY vec_id // 8) < count(*) OVER (PARTITION BY vec_id // 8) / 2 THEN 0 ELSE 1 END::INT AS index, score::FLOAT AS score FROM a
""")
def angle_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight vectors stand for the crops of a picture, which is one array: so many at most meet in a group."""
    d = read(spark, sf_dir, "embeddings").select("vec_id", reading.angle("embedding").alias("a"))
    pages = d.groupBy(F.expr("vec_id div 8").alias("page")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "a.index", "a.score"))).alias("crops"))
    pages = pages.withColumn("angles", F.expr("transform(crops, c -> named_struct('index', c.index, 'score', c.score))")).withColumn("most", reading.most_angle("angles"))
    return pages.select(F.explode(F.arrays_zip("crops", "most")).alias("x")).selectExpr("x.crops.vec_id", "x.crops.index AS own_index", "x.most.index", "x.most.score")


@query("""
WITH e AS (SELECT vec_id, trunc(greatest(0, least(255, ((v + 0.5::FLOAT)::FLOAT * 255::FLOAT)::FLOAT)))::INT AS q, (k - 1)::INT AS k FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)),
m AS (SELECT vec_id, k // 8 AS y, k % 8 AS x, q, CASE WHEN q > 150 THEN 1 ELSE 0 END AS b FROM e)
SELECT a.vec_id, a.y::INT AS y, a.x::INT AS x, a.q, max(c.b)::INT AS dilated FROM m a JOIN m c ON a.vec_id = c.vec_id AND c.y BETWEEN a.y - 1 AND a.y + 1 AND c.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL
""")
def det_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each map stays one row until the end: neighbours are looked up in it, without a join."""
    d = read(spark, sf_dir, "embeddings").select("vec_id", F.expr(f"transform({MAP}, p -> {geometry.quantised('p')})").alias("q"))
    near = "aggregate(sequence(greatest(0, k div 8 - 1), least(7, k div 8 + 1)), 0, (a, r) -> greatest(a, aggregate(sequence(greatest(0, k % 8 - 1), least(7, k % 8 + 1)), 0, (b, c) -> greatest(b, IF(q[r * 8 + c] > 150, 1, 0)))))"
    d = d.select("vec_id", F.explode(F.expr(f"transform(sequence(0, 63), k -> named_struct('y', CAST(k div 8 AS INT), 'x', k % 8, 'q', q[k], 'dilated', {near}))")).alias("p"))
    return d.select("vec_id", "p.y", "p.x", "p.q", "p.dilated")


@query("""
WITH RECURSIVE e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
m AS (SELECT vec_id, k // 8 AS y, k % 8 AS x, k FROM e WHERE trunc(greatest(0, least(255, ((v + 0.5::FLOAT)::FLOAT * 255::FLOAT)::FLOAT))) > 150),
c AS (SELECT vec_id, y, x, k AS root FROM m UNION SELECT m.vec_id, m.y, m.x, c.root FROM c JOIN m ON m.vec_id = c.vec_id AND abs(m.y - c.y) <= 1 AND abs(m.x - c.x) <= 1 AND m.k > c.root),
l AS (SELECT vec_id, y, x, min(root) AS root FROM c GROUP BY ALL)
SELECT vec_id, root::BIGINT AS first_pixel, min(x)::BIGINT AS min_x, min(y)::BIGINT AS min_y, max(x)::BIGINT AS max_x, max(y)::BIGINT AS max_y FROM l GROUP BY vec_id, root
""")
def det_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outer borders of each map's parts, by where each begins."""

    def trace(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, q in zip(part["vec_id"], part["q"], strict=True):
                for outer, p in contours.borders((q > 150).reshape(8, 8)):
                    if outer:
                        xs, ys = [x for x, _ in p], [y for _, y in p]
                        rows.append((i, p[0][1] * 8 + p[0][0], min(xs), min(ys), max(xs), max(ys)))
            yield pd.DataFrame(rows, columns=["vec_id", "first_pixel", "min_x", "min_y", "max_x", "max_y"])

    d = read(spark, sf_dir, "embeddings").select("vec_id", F.expr(f"transform({MAP}, p -> {geometry.quantised('p')})").alias("q"))
    return d.mapInPandas(trace, "vec_id long, first_pixel long, min_x long, min_y long, max_x long, max_y long")


def by_map(spark: SparkSession, sf_dir: str, schema: str, rows_of: Callable[[pd.Series], list[tuple]]) -> DataFrame:
    """What a kernel makes of each 8 x 8 map, which is one row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([r for row in part.itertuples(index=False) for r in rows_of(row)], columns=[x.split()[0] for x in schema.split(", ")])

    d = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr(MAP).alias("p"), F.expr(f"transform({MAP}, p -> {geometry.quantised('p')})").alias("q"))
    return d.mapInPandas(run, schema)


@query("""
WITH RECURSIVE e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
full_ AS (SELECT vec_id, k // 8 + 1 AS y, k % 8 + 1 AS x FROM e WHERE trunc(greatest(0, least(255, ((v + 0.5::FLOAT)::FLOAT * 255::FLOAT)::FLOAT))) > 150),
g AS (SELECT vec_id, y, x, y * 10 + x AS k FROM (SELECT DISTINCT vec_id FROM embeddings), range(10) a(y), range(10) b(x)),
m AS (SELECT g.* FROM g ANTI JOIN full_ USING (vec_id, y, x)),
c AS (SELECT vec_id, y, x, k AS root FROM m UNION SELECT m.vec_id, m.y, m.x, c.root FROM c JOIN m ON m.vec_id = c.vec_id AND abs(m.y - c.y) + abs(m.x - c.x) = 1 AND m.k > c.root),
l AS (SELECT vec_id, y, x, min(root) AS root FROM c GROUP BY ALL)
SELECT vec_id, (count(DISTINCT root) - 1)::BIGINT AS n_holes FROM l GROUP BY vec_id
""")
def det_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many borders of a map go around holes: each is a part of the empty pixels that doesn't reach the edge."""
    return by_map(spark, sf_dir, "vec_id long, n_holes long", lambda r: [(r.vec_id, sum(not outer for outer, _ in contours.borders((r.q > 150).reshape(8, 8))))])


#: A rectangle in each map, by its first and last column and row.
INSIDE = ("label % 3", "least(7, label % 3 + 1 + vec_id % 5)", "vec_id % 4", "least(7, vec_id % 4 + 1 + label % 4)")


@query(f"""
WITH e AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
m AS (SELECT vec_id, k, (v + 0.5::FLOAT)::FLOAT AS p FROM e WHERE k % 8 BETWEEN {INSIDE[0]} AND {INSIDE[1]} AND k // 8 BETWEEN {INSIDE[2]} AND {INSIDE[3]}),
g AS (SELECT vec_id, list(p ORDER BY k) AS ps FROM m GROUP BY vec_id)
SELECT vec_id, (list_reduce(list_prepend(0::FLOAT, ps), lambda a, x: (a + x)::FLOAT)::FLOAT / len(ps)::FLOAT)::FLOAT AS score FROM g
""")
def border_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean inside a border that is followed around a rectangle, filled as a polygon."""

    def one(r) -> list[tuple]:
        x0, x1, y0, y1 = r.label % 3, min(7, r.label % 3 + 1 + r.vec_id % 5), r.vec_id % 4, min(7, r.vec_id % 4 + 1 + r.label % 4)
        mask = np.zeros((8, 8), np.uint8)
        mask[y0 : y1 + 1, x0 : x1 + 1] = 1
        ((_, points),) = contours.borders(mask)
        return [(r.vec_id, float(detect.border_score(points, np.asarray(r.p, np.float32).reshape(8, 8))))]

    return by_map(spark, sf_dir, "vec_id long, score float", one)


@query("""
WITH p AS (SELECT vec_id, 3 + vec_id % 40 AS w, 2 + label % 7 AS h, vec_id % 11 AS x, label AS y FROM embeddings)
SELECT vec_id, x::FLOAT AS x0, y::FLOAT AS y0, (x + w)::FLOAT AS x1, y::FLOAT AS y1, (x + w)::FLOAT AS x2, (y + h)::FLOAT AS y2, x::FLOAT AS x3, (y + h)::FLOAT AS y3, least(w, h)::FLOAT AS edge FROM p
""")
def smallest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest rectangle around points on and in an upright one, in any order: its corners in order, and its shorter edge."""

    def one(r) -> list[tuple]:
        w, h, x, y = 3 + r.vec_id % 40, 2 + r.label % 7, r.vec_id % 11, r.label
        around = [(x + w, y + h), (x, y), (x + w // 2, y + h // 2), (x + w, y), (x, y + h), (x + 1, y), (x, y + 1), (x + w, y + h - 1)]
        box, edge = contours.smallest_box(np.roll(around, r.vec_id % 8, axis=0))
        return [(r.vec_id, *map(float, box.ravel()), edge)]

    return by_map(spark, sf_dir, "vec_id long, x0 float, y0 float, x1 float, y1 float, x2 float, y2 float, x3 float, y3 float, edge float", one)


@query("""
SELECT vec_id, CASE WHEN embedding[2] > embedding[1] AND (isnan(embedding[3]) OR embedding[3] < 0.1::FLOAT) THEN embedding[4] ELSE embedding[3] END::FLOAT AS score,
(embedding[2] > embedding[1] AND (isnan(embedding[3]) OR embedding[3] < 0.1::FLOAT)) AS again FROM embeddings
""")
def angle_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = reading.rolled_back("embedding[2]", 0.1, "a.index = 1")
    d = read(spark, sf_dir, "embeddings").withColumn("a", reading.angle("embedding"))
    return d.selectExpr("vec_id", f"IF({again}, embedding[3], embedding[2]) AS score", f"{again} AS again")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, 1 + (l_orderkey * 37) % 4000 AS w, 1 + (l_partkey * 53) % 3000 AS h FROM lineitem),
r AS (SELECT *, greatest((320::FLOAT / 48::FLOAT)::FLOAT, max((w::FLOAT / greatest(h, 1)::FLOAT)::FLOAT) OVER (PARTITION BY l_orderkey)) AS ratio, ceil((w::FLOAT * (48::FLOAT / h::FLOAT)::FLOAT)::FLOAT)::BIGINT AS resized_w FROM s)
SELECT l_orderkey, l_linenumber, ratio::FLOAT AS ratio, resized_w, greatest(trunc((48::FLOAT * ratio)::FLOAT)::BIGINT, resized_w) AS padded_w FROM r
""")
def rec_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for pictures, lines for crops."""
    d = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *SIZES)
    widest = F.max(F.expr(geometry.width_ratio("w", "h"))).over(Window.partitionBy("l_orderkey"))
    resized, wide = geometry.rec_widths("w", "h", "ratio")
    d = d.withColumn("ratio", F.greatest(F.expr(f(geometry.LEAST_RATIO)), widest))
    return d.selectExpr("l_orderkey", "l_linenumber", "ratio", f"{resized} AS resized_w", f"{wide} AS padded_w")


@query(f"""
WITH s AS (SELECT l_orderkey, l_linenumber, list_sort([{", ".join(f"{{'x': {x}, 'i': {i}, 'y': {y}}}" for i, (x, y) in enumerate(CORNERS))}]) AS s FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, [CASE WHEN s[2].y > s[1].y THEN s[1] ELSE s[2] END, CASE WHEN s[4].y > s[3].y THEN s[3] ELSE s[4] END, CASE WHEN s[4].y > s[3].y THEN s[4] ELSE s[3] END, CASE WHEN s[2].y > s[1].y THEN s[2] ELSE s[1] END] AS b FROM s)
SELECT l_orderkey, l_linenumber, {", ".join(f"b[{i + 1}].{a}::BIGINT AS {a}{i}" for i in range(4) for a in "xy")} FROM b
""")
def mini_box_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(points()).alias("p"))
    return d.withColumn("b", geometry.box_order("p")).select("l_orderkey", "l_linenumber", *corner_columns("b"))


RECT = "array(named_struct('x', 0, 'y', 0), named_struct('x', w, 'y', 0), named_struct('x', w, 'y', h), named_struct('x', 0, 'y', h))"


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, 1 + (l_orderkey * 37) % 4000 AS w, 1 + (l_partkey * 53) % 3000 AS h FROM lineitem),
a AS (SELECT *, abs(((0::FLOAT + (w::FLOAT * 0::FLOAT / 2::FLOAT)::FLOAT)::FLOAT + ((0 - w)::FLOAT * (2 * h)::FLOAT / 2::FLOAT)::FLOAT)::FLOAT) AS area, 2::DOUBLE * (w + h) AS perimeter FROM s)
SELECT l_orderkey, l_linenumber, area::FLOAT AS area, perimeter::DOUBLE AS perimeter, CASE WHEN w < 1.001 AND h < 1.001 THEN NULL ELSE ((area * 1.6::FLOAT)::FLOAT / perimeter::FLOAT)::FLOAT END AS distance FROM a
""")
def unclip_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *SIZES).withColumn("p", F.expr(RECT))
    return d.select("l_orderkey", "l_linenumber", F.abs(geometry.signed_area("p", 4)).alias("area"), geometry.perimeter("p", 4).alias("perimeter"), geometry.offset_distance("p", 1.6).alias("distance"))


@query("""
WITH e AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
m AS (SELECT vec_id, k, (v + 0.5::FLOAT)::FLOAT AS p FROM e WHERE k % 8 BETWEEN label % 3 AND label % 3 + vec_id % 5 AND k // 8 BETWEEN vec_id % 4 AND vec_id % 4 + label % 4),
g AS (SELECT vec_id, list(p ORDER BY k) AS ps FROM m GROUP BY vec_id)
SELECT e.vec_id, CASE WHEN ps IS NULL THEN 0::FLOAT ELSE (list_reduce(list_prepend(0::FLOAT, ps), lambda a, x: (a + x)::FLOAT)::FLOAT / len(ps)::FLOAT)::FLOAT END AS score FROM embeddings e LEFT JOIN g USING (vec_id)
""")
def box_score_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = "transform(sequence(0, 63), k -> IF(k % 8 BETWEEN label % 3 AND label % 3 + vec_id % 5 AND k div 8 BETWEEN vec_id % 4 AND vec_id % 4 + label % 4, 1, 0))"
    d = read(spark, sf_dir, "embeddings").select("vec_id", F.expr(MAP).alias("p"), F.expr(mask).alias("m"))
    return d.select("vec_id", geometry.masked_mean("p", "m").alias("score"))


@query("""
SELECT l_orderkey, l_linenumber FROM (SELECT *, (l_orderkey % 9)::BIGINT AS n, (l_partkey % 70 / 10.0)::FLOAT AS edge, CASE WHEN l_suppkey % 11 = 0 THEN 'NaN'::FLOAT ELSE l_discount::FLOAT * 10 END AS score, (l_partkey % 90 / 10.0)::FLOAT AS grown FROM lineitem)
WHERE n > 2 AND edge >= 3 AND (isnan(score) OR score >= 0.5::FLOAT) AND grown >= 5
""")
def box_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN scores stay, as they aren't below the threshold."""
    d = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_orderkey % 9 AS n", "CAST(l_partkey % 70 / 10.0 AS FLOAT) AS edge", "IF(l_suppkey % 11 = 0, CAST('NaN' AS FLOAT), CAST(l_discount AS FLOAT) * CAST(10 AS FLOAT)) AS score", "CAST(l_partkey % 90 / 10.0 AS FLOAT) AS grown")
    return d.where(geometry.passes("n", "edge", "score", "grown", 0.5)).select("l_orderkey", "l_linenumber")


SCALED = "named_struct('scale_w', CAST(0.7 AS FLOAT), 'scale_h', CAST(1.3 AS FLOAT), 'src_w', 100L, 'src_h', 60L)"
SHIFTED = tuple((f"({x}) - 20", f"({y}) - 20") for x, y in CORNERS)


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"least(trunc(greatest(0, (({c})::FLOAT / {s}::FLOAT)::FLOAT))::BIGINT, {m}) AS {a}{i}" for i, p in enumerate(SHIFTED) for c, a, s, m in zip(p, "xy", ("0.7", "1.3"), (100, 60), strict=True)) + " FROM lineitem")
def rescale_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in SHIFTED) + ")"
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(p).alias("p"), F.expr(SCALED).alias("s"))
    return d.withColumn("b", geometry.rescaled("p", "s")).select("l_orderkey", "l_linenumber", *corner_columns("b"))


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"trunc(greatest(0, (({c})::FLOAT - 50::FLOAT)::FLOAT))::BIGINT AS {a}{i}" for i, p in enumerate(CORNERS) for c, a in zip(p, "xy", strict=True)) + " FROM lineitem")
def unpad_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(points()).alias("p"))
    return d.withColumn("b", F.expr(geometry.unpadded("p", 50))).select("l_orderkey", "l_linenumber", *corner_columns("b"))


def _length(i: int, j: int) -> str:
    (x0, y0), (x1, y1) = CORNERS[i], CORNERS[j]
    return f"sqrt((pow(({x0}) - ({x1}), 2)::FLOAT + pow(({y0}) - ({y1}), 2)::FLOAT)::FLOAT)::FLOAT"


XS, YS = (", ".join(p[k] for p in CORNERS) for k in (0, 1))


@query(f"""
SELECT *, h >= w * 3 // 2 AS turned FROM (SELECT l_orderkey, l_linenumber, least({XS})::BIGINT AS min_x, least({YS})::BIGINT AS min_y, (greatest({XS}) - least({XS}))::BIGINT AS box_w, (greatest({YS}) - least({YS}))::BIGINT AS box_h,
trunc({_length(0, 1)})::BIGINT AS w, trunc({_length(0, 3)})::BIGINT AS h FROM lineitem)
""")
def crop_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(points()).alias("p"))
    return d.withColumn("c", geometry.crop_plan("p")).select("l_orderkey", "l_linenumber", "c.*")


CHANNELS = ((0.485 * 255, 1 / 0.229 / 255), (0.456 * 255, 1 / 0.224 / 255), (0.406 * 255, 1 / 0.225 / 255))


@query(" UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, {c} AS channel, (((l_partkey % 256)::FLOAT * {n!r}::FLOAT)::FLOAT - ({m!r}::FLOAT * {n!r}::FLOAT)::FLOAT)::FLOAT AS v FROM lineitem" for c, (m, n) in enumerate(CHANNELS)))
def normalize_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "array(l_partkey % 256) AS a")
    three = F.array(*(F.struct(F.lit(c).alias("channel"), geometry.normalised("a", m, n)[0].alias("v")) for c, (m, n) in enumerate(CHANNELS)))
    return d.select("l_orderkey", "l_linenumber", F.explode(three).alias("t")).select("l_orderkey", "l_linenumber", "t.channel", "t.v")


@query("""
WITH k AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), n AS (SELECT doc_id, list_concat(['#'], s, [' ']) AS a, list_concat(['#'], list_filter(s, lambda x: x <> ''), [' ']) AS b FROM k)
SELECT doc_id, len(a)::INT AS metadata_keys, len(b)::INT AS file_keys, a[2] AS first_key, b[len(b) - 1] AS last_key FROM n
""")
def dict_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", reading.keys_of_metadata(F.col("text")).alias("a"), reading.keys_of_file(F.col("text")).alias("b"))
    return d.selectExpr("doc_id", "size(a) AS metadata_keys", "size(b) AS file_keys", "a[1] AS first_key", "b[size(b) - 2] AS last_key")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, vec_id and a block made from a vector: a box, an angle and a decoded line. Scores are eighths, exact in any notation."""
    d = lines(spark, sf_dir).withColumn("a", reading.angle("embedding"))
    eighth = lambda x: f"CAST(floor({x} * 8) / 8 AS FLOAT)"
    block = f"named_struct('box_points', array(named_struct('x', vec_id, 'y', CAST(label AS BIGINT))), 'box_score', {eighth('embedding[5]')}, 'angle_index', a.index, 'angle_score', {eighth('a.score')}, 'text', line.text, 'text_score', {eighth('line.text_score')})"
    return d.select("vec_id", "label", F.expr(f"array({block})").alias("text_blocks"))


RESULT_SQL = f"""
l AS ({CTC_SQL}), b AS (SELECT vec_id, label, (floor(embedding[6] * 8) / 8)::FLOAT AS box_score, CASE WHEN embedding[2] > embedding[1] THEN 1 ELSE 0 END AS angle_index, (floor(greatest(embedding[1], embedding[2]) * 8) / 8)::FLOAT AS angle_score, text, (floor(text_score * 8) / 8)::FLOAT AS text_score FROM embeddings JOIN l USING (vec_id))
"""


@query(f"WITH {RESULT_SQL} SELECT vec_id, 0::INT AS block_index, vec_id AS x, label::BIGINT AS y, box_score, angle_index::INT AS angle_index, angle_score, text, text_score FROM b")
def result_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = text_blocks(results(spark, sf_dir))
    return d.selectExpr("vec_id", "block_index", "box_points[0].x AS x", "box_points[0].y AS y", "box_score", "angle_index", "angle_score", "text", "text_score")


@query(f"WITH {RESULT_SQL} SELECT vec_id, 1::INT AS n_blocks, vec_id AS x, angle_index::INT AS angle_index, text, text_score FROM b")
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON and read again."""
    d = results(spark, sf_dir).withColumn("json", display.result_json("text_blocks")).withColumn("back", display.from_result_json("json"))
    return d.selectExpr("vec_id", "size(back) AS n_blocks", "back[0].box_points[0].x AS x", "back[0].angle_index AS angle_index", "back[0].text AS text", "back[0].text_score AS text_score")


@query(f"""
WITH {RESULT_SQL} SELECT vec_id, i::INT AS block_index, greatest(0, vec_id + i * 10 - 50) AS x, greatest(0, label * 30 - 50)::BIGINT AS y, box_score, ((angle_index + i) % 2)::INT AS angle_index, angle_score, text || i AS text, text_score FROM b, range(2) r(i)
""")
def result_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, angles and lines of a picture put together by place, without the margin, as the pipeline does."""
    one = results(spark, sf_dir).select("vec_id", "label", F.col("text_blocks")[0].alias("b"))
    two = lambda x: F.expr(f"transform(sequence(0, 1), i -> {x})")
    parts = one.select(
        "vec_id",
        two("named_struct('points', array(named_struct('x', vec_id + i * 10, 'y', CAST(label * 30 AS BIGINT))), 'score', b.box_score)").alias("boxes"),
        two("named_struct('index', (b.angle_index + i) % 2, 'score', b.angle_score)").alias("angles"),
        two("named_struct('text', concat(b.text, i), 'text_score', b.text_score)").alias("lines"),
    )
    d = text_blocks(parts.withColumn("text_blocks", assembled(50)).select("vec_id", "text_blocks"))
    return d.selectExpr("vec_id", "block_index", "box_points[0].x AS x", "box_points[0].y AS y", "box_score", "angle_index", "angle_score", "text", "text_score")


def _shown(x: str) -> str:
    return f"regexp_replace({x}::VARCHAR, '\\.0$', '')"


@query(f"""WITH {RESULT_SQL} SELECT vec_id, 'TextBlock[BoxPointsLen(1), BoxScore(' || {_shown('box_score')} || '), AngleIndex(' || angle_index || '), AngleScore(' || {_shown('angle_score')} || '), Text(' || text || '), TextScore(' || {_shown('text_score')} || ')]' AS shown FROM b""")
def result_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("vec_id", display.result_text("text_blocks").alias("shown"))


#: Whole names and numbers of suppliers, a line each, in the letters that the stand-in networks know.
LINES = ("s_name", "CAST(s_suppkey * 7919 AS {text})", "CAST(CAST(abs(floor(s_acctbal)) AS BIGINT) AS {text})")


def line_columns(text: str, flag: str = "") -> list[str]:
    return [f"upper(regexp_replace({x.format(text=text)}, '[^A-Za-z0-9]', ''{flag}))" for x in LINES]


def rendered(spark: SparkSession, sf_dir: str, turned: bool = False) -> DataFrame:
    """s_suppkey, image: each supplier's lines as a page."""

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 64):
                some = part.iloc[at : at + 64]
                yield some[["s_suppkey"]].assign(image=[struct_of(standin.drawn(list(x), turned)) for x in some["lines"]])

    d = read(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"array({', '.join(line_columns('STRING'))}) AS lines")
    d = d.repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey")  # a few bytes become a picture: share them out before
    return d.mapInPandas(draw, f"s_suppkey long, image {IMAGE}")


def lines_read(blocks: DataFrame, placed: bool = True) -> DataFrame:
    """A row a line from top to bottom; near: all four corners are within NEAR pixels of the line's strip, grown as far as boxes are."""
    top = "array_min(transform(b.box_points, p -> p.y))"
    ordered = F.expr(f"array_sort(transform(text_blocks, b -> named_struct('top', {top}, 'b', b)), (l, r) -> IF(l.top < r.top, -1, 1))")
    d = blocks.select("s_suppkey", F.size("text_blocks").alias("n_blocks"), F.posexplode(ordered).alias("line", "o")).select("s_suppkey", "n_blocks", "line", "o.b.*")
    w, h = f"(greatest(4, length(text)) * {standin.CELL})", standin.HEIGHT
    y, grown = f"({standin.MARGIN} + line * {h + 3 * standin.MARGIN})", f"({w} * {h} * 1.6D / (2 * ({w} + {h})))"
    low = lambda v: f"greatest(0, {v} - {grown})"
    right, bottom = f"({standin.MARGIN} + {w} + {grown})", f"({y} + {h} + {grown})"
    corners = ((low(standin.MARGIN), low(y)), (right, low(y)), (right, bottom), (low(standin.MARGIN), bottom))
    near = " AND ".join(f"abs(box_points[{i}].x - {x}) <= {NEAR} AND abs(box_points[{i}].y - {y}) <= {NEAR}" for i, (x, y) in enumerate(corners))
    return d.selectExpr("s_suppkey", "n_blocks", "line", "text", "angle_index", *([f"{near} AS near", "box_score > 0.9 AND text_score > 0.9 AS sure"] if placed else []))


#: Pixels that a corner may be off: resizing and the border's own width.
NEAR = 5


def lines_sql(angle: int, more: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT s_suppkey, 3::INT AS n_blocks, {i}::INT AS line, {x} AS text, {angle}::INT AS angle_index{more} FROM supplier" for i, x in enumerate(line_columns("VARCHAR", ", 'g'")))
    return parts


@query(lines_sql(0, ", TRUE AS near, TRUE AS sure"))
def ocr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of lines through the whole pipeline with the stand-in networks."""
    return lines_read(OcrPipeline(standin.StandInModels()).detect(rendered(spark, sf_dir)))


@query(lines_sql(1))
def ocr_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages upside down: each line is found turned by the classifier, confirmed by the vote, and read after half a turn. From
    below, the last line comes first."""
    d = OcrPipeline(standin.StandInModels()).detect(rendered(spark, sf_dir, True), OcrOptions(do_angle=True, most_angle=True))
    return lines_read(d, placed=False).withColumn("line", (F.col("n_blocks") - 1 - F.col("line")).cast("int"))


@dataclass(frozen=True)
class TurnsAll(standin.StandInModels):
    """A classifier that turns what stands upright."""

    def classifier(self):
        return turn


def turn(x: np.ndarray) -> np.ndarray:
    return np.array([[0.1, 0.9]], np.float32)


@query(lines_sql(1))
def ocr_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that were turned by mistake read badly and are read again as they were; the angle stays."""
    return lines_read(OcrPipeline(TurnsAll()).detect_angle_rollback(rendered(spark, sf_dir), OcrOptions(do_angle=True), 0.99), placed=False)
