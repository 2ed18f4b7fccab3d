"""Shared plumbing for registered queries: rounding of doubles for the oracle compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from styloscope.functions.numeric import r6


def finalize(df: DataFrame) -> DataFrame:
    """Round every floating column to a fixed number of decimals (summation order differs by engine)."""
    return df.select(*[r6(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])
