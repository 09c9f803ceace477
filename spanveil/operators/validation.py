"""Identifier validation as a column data-quality job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.checksums import VALIDATORS


def validate_identifier_column(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Add a Boolean ``valid`` column for one identifier kind."""
    return df.withColumn("valid", VALIDATORS[kind](F.col(column)))


def validity_counts(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Rows per verdict; combines on the map side before its small shuffle."""
    return validate_identifier_column(df, column, kind).groupBy("valid").count()
