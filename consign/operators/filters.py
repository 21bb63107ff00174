"""Date-range predicates (P2, P3) with partition pruning on the stored layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT_FROM, DEFAULT_TO


def _prune(df: DataFrame, frm: str | None, to: str | None) -> DataFrame:
    # Text order of 'YYYY-MM' prefixes follows the text order of dates, so the
    # month filter is implied by the date filter; Catalyst cannot derive it.
    if "month" not in df.columns:
        return df
    if frm:
        df = df.where(F.col("month") >= F.lit(frm[:7]))
    if to:
        df = df.where(F.col("month") <= F.lit(to[:7]))
    return df


def in_optional_range(df: DataFrame, frm: str | None = None, to: str | None = None,
                      col: str = "date") -> DataFrame:
    """Each bound optional and inclusive; '' or None means no bound."""
    df = _prune(df, frm, to)
    if frm:
        df = df.where(F.col(col) >= F.lit(frm))
    if to:
        df = df.where(F.col(col) <= F.lit(to))
    return df


def in_report_range(df: DataFrame, frm: str | None = None, to: str | None = None,
                    col: str = "date") -> DataFrame:
    """``date BETWEEN from AND to`` with default bounds for empty input."""
    frm = frm or DEFAULT_FROM
    to = to or DEFAULT_TO
    df = _prune(df, frm, to)
    return df.where(F.col(col).between(F.lit(frm), F.lit(to)))
