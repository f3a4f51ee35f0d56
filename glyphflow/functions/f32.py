"""SQL text for 32-bit arithmetic: each step is narrowed, since division and roots widen to 64 bits.

A quotient or a root of two 32-bit numbers taken in 64 bits and then narrowed is the 32-bit result exactly.
"""

from __future__ import annotations

U32, I32 = 4294967295, (-2147483648, 2147483647)


def f(x: str) -> str:
    return f"CAST({x} AS FLOAT)"


def div(a: str, b: str) -> str:
    return f(f"{f(a)} / {f(b)}")


def sqrt(x: str) -> str:
    return f(f"sqrt({f(x)})")


def to_uint(x: str, most: int = U32) -> str:
    """Towards zero, held to 0 and most; NaN is 0."""
    return f"CAST(CASE WHEN isnan({x}) OR {x} <= 0 THEN 0 WHEN {x} >= {most} THEN {most} ELSE {x} END AS BIGINT)"
