"""Read either Sales layout as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SALES


def to_canonical_sales(df: DataFrame) -> DataFrame:
    """Rename ``sold_date`` to ``date`` and add missing canonical columns as NULL."""
    if "sold_date" in df.columns and "date" not in df.columns:
        df = df.withColumnRenamed("sold_date", "date")
    cols = []
    for f in SALES.fields:
        cols.append(F.col(f.name) if f.name in df.columns
                    else F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def unify_sales(*layouts: DataFrame) -> DataFrame:
    """Union any mix of the two layouts by column name (no shuffle)."""
    out = None
    for df in layouts:
        c = to_canonical_sales(df)
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
    return out
