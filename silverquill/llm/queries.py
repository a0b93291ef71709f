"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .late import op13_late_overwrite
from .licences import op9_licences, op9_sql
from .lines import op4_line_dedup, op4_sql
from .lm import op7_lm_score
from .media import op1_matroska
from .merkle import op11_merkle, op11_sql
from .mixing import op6_mixing
from .near import op5_near_dedup
from .packing import op3_best_fit_packing
from .quality import op8_quality
from .urls import op2_sql, op2_url_filters
from .vectors import op10_embedding_dedup, op10_sql
from .wrappers import op12_html_extraction

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_matroska, op2_url_filters, op3_best_fit_packing, op4_line_dedup, op5_near_dedup, op6_mixing, op7_lm_score, op8_quality, op9_licences, op10_embedding_dedup, op11_merkle, op12_html_extraction, op13_late_overwrite)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": op2_sql(), "op4_line_dedup": op4_sql(), "op9_licences": op9_sql(), "op10_embedding_dedup": op10_sql(), "op11_merkle": op11_sql()}
