"""Sizes, boxes and points as column expressions. A point is struct<x, y>, a box an array of four points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .f32 import U32, div, f, sqrt, to_uint

#: The side that sizes are cut to, the recogniser's height, its least width over height.
STEP, REC_HEIGHT, LEAST_RATIO = 32, 48, "CAST(320 AS FLOAT) / CAST(48 AS FLOAT)"
#: Points of a border and shortest edges of a box before and after it is grown, at least. Fixed values.
LEAST_POINTS, LEAST_EDGE, LEAST_GROWN = 3, 3.0, 5.0


def target_side(w: str, h: str, max_side: int, padding: int) -> str:
    """SQL: the longer side, or max_side if that is smaller and not 0, with both margins."""
    longer = f"greatest({w}, {h})"
    return f"({longer if max_side == 0 else f'least({longer}, {max_side})'} + {2 * padding})"


def scale_param(w: str, h: str, target: str) -> Column:
    """struct<src_w, src_h, dst_w, dst_h, scale_w, scale_h>: the longer side becomes target, sides are cut to multiples of 32.

    A side that isn't a multiple is at least 32; a side of 0 stays 0.
    """
    ratio = f"CASE WHEN {w} > {h} THEN {div(target, w)} ELSE {div(target, h)} END"
    # Sides are whole and not negative: the product is only cut, and what lies below 32 but above 0 becomes 32.
    whole = lambda side: f"CAST(least({f(side)} * {ratio}, CAST({U32} AS FLOAT)) AS BIGINT)"
    cut = lambda side: f"({whole(side)} - {whole(side)} % {STEP} + IF({whole(side)} BETWEEN 1 AND {STEP - 1}, {STEP}, 0))"
    dw, dh = cut(w), cut(h)
    return F.expr(f"named_struct('src_w', CAST({w} AS BIGINT), 'src_h', CAST({h} AS BIGINT), 'dst_w', {dw}, 'dst_h', {dh}, 'scale_w', {div(dw, w)}, 'scale_h', {div(dh, h)})")


def edge(points: str, i: int, j: int) -> str:
    """SQL: the 32-bit length between two points of a box."""
    d = lambda axis: f"({f(f'{points}[{i}].{axis}')} - {f(f'{points}[{j}].{axis}')})"
    return sqrt(f"{d('x')} * {d('x')} + {d('y')} * {d('y')}")


def box_order(points: str) -> Column:
    """Corners as top left, top right, bottom right, bottom left: two pairs by x, in the order given where x is equal.

    Five comparisons put four corners in order, by x and then by place, without a sort that Spark would interpret.
    """
    p = [f"named_struct('x', {points}[{i}].x, 'i', {i}, 'y', {points}[{i}].y)" for i in range(4)]
    low, high = (lambda a, b: f"least({a}, {b})"), (lambda a, b: f"greatest({a}, {b})")
    a, b, c, d = low(p[0], p[1]), high(p[0], p[1]), low(p[2], p[3]), high(p[2], p[3])
    mid = high(a, c), low(b, d)
    s = [low(a, c), low(*mid), high(*mid), high(b, d)]
    one = lambda first, i, j: f"IF({first}, named_struct('x', {s[i]}.x, 'y', {s[i]}.y), named_struct('x', {s[j]}.x, 'y', {s[j]}.y))"
    left, right = f"{s[1]}.y > {s[0]}.y", f"{s[3]}.y > {s[2]}.y"
    return F.expr(f"array({one(left, 0, 1)}, {one(right, 2, 3)}, {one(right, 3, 2)}, {one(left, 1, 0)})")


def signed_area(points: str, corners: int | None = None) -> Column:
    """The sum of trapezoids in 32 bits, point by point. corners: how many points there are, where that is known."""

    def part(i: str, nxt: str) -> str:
        dx, sy = f"({f(f'{points}[{nxt}].x')} - {f(f'{points}[{i}].x')})", f"({f(f'{points}[{nxt}].y')} + {f(f'{points}[{i}].y')})"
        return f(f"{f(f'{dx} * {sy}')} / 2")

    if corners is None:
        return F.expr(f"aggregate(sequence(0, size({points}) - 1), CAST(0 AS FLOAT), (a, i) -> CAST(a + {part('i', f'(i + 1) % size({points})')} AS FLOAT))")
    out = f("0")
    for i in range(corners):
        out = f(f"{out} + {part(str(i), str((i + 1) % corners))}")
    return F.expr(out)


def perimeter(points: str, corners: int | None = None) -> Column:
    """The closed length in 64 bits; 0 without points."""
    d = lambda i, nxt, axis: f"(CAST({points}[{nxt}].{axis} AS DOUBLE) - CAST({points}[{i}].{axis} AS DOUBLE))"
    part = lambda i, nxt: f"sqrt({d(i, nxt, 'x')} * {d(i, nxt, 'x')} + {d(i, nxt, 'y')} * {d(i, nxt, 'y')})"
    if corners is None:
        return F.expr(f"IF(size({points}) = 0, 0D, aggregate(sequence(0, greatest(0, size({points}) - 1)), 0D, (a, i) -> a + {part('i', f'(i + 1) % size({points})')}))")
    return F.expr(" + ".join(["0D", *(part(str(i), str((i + 1) % corners)) for i in range(corners))]))


def offset_distance(points: str, ratio: float) -> Column:
    """How far a box grows: area by ratio over perimeter, in 32 bits but for the perimeter's sum; null if both edges are under 1.001."""
    area, length = F.abs(signed_area(points, 4)), perimeter(points, 4).cast("float")
    tiny = F.expr(f"{edge(points, 0, 1)} < CAST(1.001 AS FLOAT) AND {edge(points, 1, 2)} < CAST(1.001 AS FLOAT)")
    return F.when(~tiny, ((area * F.lit(ratio).cast("float")).cast("float") / length).cast("float"))


def rescaled(points: str, scale: str) -> Column:
    """Points of the resized picture in the padded one: cut towards zero, from 0 to its size, which counts as inside."""
    at = lambda axis, side: f"least({to_uint(div(f'p.{axis}', f'{scale}.scale_{side}'))}, {scale}.src_{side})"
    return F.expr(f"transform({points}, p -> named_struct('x', {at('x', 'w')}, 'y', {at('y', 'h')}))")


def unpadded(points: str, padding: int) -> str:
    """SQL: points without the margin, not below 0; nothing holds them to the picture's far sides."""
    at = lambda axis: to_uint(f(f"{f(f'_p.{axis}')} - {f(str(padding))}"))
    return f"transform({points}, _p -> named_struct('x', {at('x')}, 'y', {at('y')}))"


def passes(points: str, edge: str, score: str, grown: str, thresh: float) -> str:
    """SQL: a border of so many points becomes a box: its shorter edge, its score (NaN passes) and its grown box's shorter edge are
    large enough."""
    return f"({points} > {LEAST_POINTS - 1} AND {edge} >= {f(repr(LEAST_EDGE))} AND (isnan({score}) OR {score} >= {f(repr(thresh))}) AND {grown} >= {f(repr(LEAST_GROWN))})"


def crop_plan(points: str) -> Column:
    """struct<min_x, min_y, box_w, box_h, w, h, turned>: the part that is cut out, the size that it is warped to, and whether
    that is then turned, which it is from one and a half times as high as wide."""
    least = lambda axis: f"array_min(transform({points}, p -> p.{axis}))"
    most = lambda axis: f"array_max(transform({points}, p -> p.{axis}))"
    w, h = to_uint(edge(points, 0, 1)), to_uint(edge(points, 0, 3))
    return F.expr(f"named_struct('min_x', {least('x')}, 'min_y', {least('y')}, 'box_w', {most('x')} - {least('x')}, 'box_h', {most('y')} - {least('y')}, 'w', {w}, 'h', {h}, 'turned', {h} >= {w} * 3 div 2)")


def width_ratio(w: str, h: str) -> str:
    return div(w, f"greatest({h}, 1)")


def rec_widths(w: str, h: str, ratio: str) -> tuple[str, str]:
    """SQL: the width of a crop at the recogniser's height, and the width that it is padded to."""
    resized = f"CAST(ceil({f(f'{f(w)} * {div(str(REC_HEIGHT), h)}')}) AS BIGINT)"
    return resized, f"greatest({to_uint(f(f'{f(str(REC_HEIGHT))} * {f(ratio)}'))}, {resized})"


def normalised(values: str, mean: float, norm: float) -> Column:
    """v * norm - mean * norm, each step in 32 bits."""
    return F.expr(f"transform({values}, v -> CAST(CAST({f('v')} * {f(repr(norm))} AS FLOAT) - CAST({f(repr(mean))} * {f(repr(norm))} AS FLOAT) AS FLOAT))")


def quantised(p: str) -> str:
    """SQL: a probability as 0 to 255."""
    return f"CAST({to_uint(f(f'{f(p)} * CAST(255 AS FLOAT)'), 255)} AS INT)"


def masked_mean(values: str, mask: str) -> Column:
    """The 32-bit mean, summed in order, of the values where the mask is above 0; 0 if it is nowhere."""
    total = f"aggregate(zip_with({values}, {mask}, (v, m) -> IF(m > 0, v, CAST(NULL AS FLOAT))), CAST(0 AS FLOAT), (a, v) -> CAST(IF(v IS NULL, a, a + v) AS FLOAT))"
    count = f"size(filter({mask}, m -> m > 0))"
    return F.expr(f"IF({count} = 0, CAST(0 AS FLOAT), {div(total, count)})")
