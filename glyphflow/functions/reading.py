"""Orientation votes, greedy decoding and key lists as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .f32 import f

#: The least 32-bit number, from which maxima start.
LOWEST = "CAST(-3.4028235E38D AS FLOAT)"


def keys_of_metadata(text: Column) -> Column:
    """The blank, a key a line with empty ones kept, and the space."""
    return F.concat(F.array(F.lit("#")), F.split(text, "\n"), F.array(F.lit(" ")))


def keys_of_file(text: Column) -> Column:
    """The blank, a key a line without empty ones, and the space. A carriage return is part of its key."""
    return F.concat(F.array(F.lit("#")), F.filter(F.split(text, "\n"), lambda x: x != ""), F.array(F.lit(" ")))


def angle(scores: str) -> Column:
    """struct<index, score> of the first two scores: the second only if it is larger; none at all is index 0 of the lowest score."""
    second = f"size({scores}) > 1 AND NOT isnan({scores}[0]) AND NOT isnan({scores}[1]) AND {scores}[1] > {scores}[0]"
    return F.expr(f"CASE WHEN size({scores}) = 0 THEN named_struct('index', 0, 'score', {LOWEST}) WHEN {second} THEN named_struct('index', 1, 'score', {scores}[1]) ELSE named_struct('index', 0, 'score', {scores}[0]) END")


def most_angle(angles: str) -> Column:
    """The angles of one picture with the index of the majority, 1 for a tie, and their own scores."""
    vote = f"IF(CAST(aggregate({angles}, 0, (_n, _a) -> _n + _a.index) AS FLOAT) < CAST(size({angles}) AS FLOAT) / 2, 0, 1)"
    return F.expr(f"transform({angles}, _b -> named_struct('index', {vote}, 'score', _b.score))")


def rolled_back(score: str, threshold: float, turned: str) -> str:
    """SQL: whether a crop that was turned is read again as it was."""
    return f"(({turned}) AND (isnan({score}) OR {score} < {f(repr(threshold))}))"


def decoded(steps: str, keys: str) -> Column:
    """struct<text, text_score> of an array of steps with a score a class.

    A step's class is its first largest score, NaN never; class 0 if there is none. It adds its key unless it is 0, beyond
    the keys or the class of the step before, which counts even if it added nothing. The score is the mean of those added.
    """
    best = f"transform({steps}, _s -> aggregate(_s, named_struct('i', 0, 'at', 0, 'm', {LOWEST}), (_a, _x) -> named_struct('i', _a.i + 1, 'at', IF(NOT isnan(_x) AND _x > _a.m, _a.i, _a.at), 'm', IF(NOT isnan(_x) AND _x > _a.m, _x, _a.m))))"
    added = f"filter(transform(_b, (_x, _i) -> named_struct('at', _x.at, 'm', _x.m, 'last', IF(_i = 0, -1, _b[greatest(_i - 1, 0)].at))), _x -> _x.at > 0 AND _x.at < size({keys}) AND _x.at <> _x.last)"
    mean = "IF(size(_e) = 0, CAST(0 AS FLOAT), CAST(aggregate(_e, CAST(0 AS FLOAT), (_a, _x) -> CAST(_a + _x.m AS FLOAT)) / CAST(size(_e) AS FLOAT) AS FLOAT))"
    return F.expr(f"transform(transform(array({best}), _b -> {added}), _e -> named_struct('text', array_join(transform(_e, _x -> {keys}[_x.at]), ''), 'text_score', {mean}))[0]")
