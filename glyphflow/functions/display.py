"""Results as text and as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: str) -> str:
    """SQL: a 32-bit number in plain digits, whole ones without a point."""
    s = f"CAST({x} AS STRING)"
    digits, power = f"replace(replace(split({s}, 'E')[0], '.', ''), '-', '')", f"CAST(split({s}, 'E')[1] AS INT)"
    digits = f"IF({digits} = '0', '0', rtrim('0', {digits}))"
    large = f"concat(rpad({digits}, greatest({power} + 1, length({digits})), '0'))"
    small = f"concat('0.', repeat('0', -{power} - 1), {digits})"
    return f"CASE WHEN isnan({x}) THEN 'NaN' WHEN {s} = 'Infinity' THEN 'inf' WHEN {s} = '-Infinity' THEN '-inf' WHEN {s} LIKE '%E%' THEN concat(IF({x} < 0, '-', ''), IF({power} > 0, {large}, {small})) WHEN {s} LIKE '%.0' THEN left({s}, length({s}) - 2) ELSE {s} END"


def box_text(box: str) -> Column:
    """Of struct<points, score>. Fewer than four points: null."""
    points = ", ".join(f"'[x: ', {box}.points[{i}].x, ', y: ', {box}.points[{i}].y, ']{', ' if i < 3 else ']'}'" for i in range(4))
    return F.expr(f"IF(size({box}.points) < 4, NULL, concat('TextBox [score(', {number(f'{box}.score')}, '), ', {points}))")


def angle_text(angle: str) -> Column:
    return F.expr(f"concat(IF({angle}.index >= 0, 'Angle', 'AngleDisabled'), '[Index(', {angle}.index, '), Score(', {number(f'{angle}.score')}, ')]')")


def line_text(line: str) -> Column:
    return F.expr(f"concat('TextLine[Text(', {line}.text, '),TextScore(', {number(f'{line}.text_score')}, ')]')")


def scale_text(s: str) -> Column:
    return F.expr(f"concat('src_width:', {s}.src_w, ',src_height:', {s}.src_h, ',dst_width:', {s}.dst_w, ',dst_height:', {s}.dst_h, ',scale_width:', {number(f'{s}.scale_w')}, ',scale_height:', {number(f'{s}.scale_h')})")


def result_text(blocks: str) -> Column:
    """Of an array of text blocks, one after the other."""
    parts = f"'TextBlock[BoxPointsLen(', size(b.box_points), '), BoxScore(', {number('b.box_score')}, '), AngleIndex(', b.angle_index, '), AngleScore(', {number('b.angle_score')}, '), Text(', b.text, '), TextScore(', {number('b.text_score')}, ')]'"
    return F.expr(f"array_join(transform({blocks}, b -> concat({parts})), '')")


def result_json(blocks: str) -> Column:
    """{"text_blocks": [...]}; from_result_json reads it back."""
    return F.to_json(F.struct(F.col(blocks).alias("text_blocks")))


def from_result_json(text: str) -> Column:
    from glyphflow.schema import BLOCKS

    return F.from_json(F.col(text), f"text_blocks {BLOCKS}")["text_blocks"]
