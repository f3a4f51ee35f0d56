"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op10_sql, op10_vptree
from .bpe import op8_bpe
from .licenses import op4_license_scan
from .lm import op1_lm_score
from .media import op6_media_tiff
from .mixing import op2_mixing
from .ngram_join import op3_ngram_join, op3_sql
from .pii import op9_pii
from .toxicity import op7_toxicity
from .urls import op5_sql, op5_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_lm_score, op2_mixing, op3_ngram_join, op4_license_scan, op5_url_filter, op6_media_tiff, op7_toxicity, op8_bpe, op9_pii, op10_vptree)
}

SQL: dict[str, str] = {"op3_ngram_join": op3_sql(), "op5_url_filter": op5_sql(), "op10_vptree": op10_sql()}
