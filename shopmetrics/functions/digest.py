"""Order-free digests of whole tables, column by column, that another engine can
repeat: for comparing what was written with what should have been."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, NumericType, TimestampNTZType, TimestampType


def round6(c: Column) -> Column:
    """Comparison rounding: 6 places after a 1e-9 nudge away from zero, so a
    value sitting on a rounding tie (e.g. 1369.27 / 32 = 42.7896875) rounds the
    same way whatever ulp-level noise the summation order left on it."""
    c = c.cast("double")
    return F.round(c + F.signum(c) * F.lit(1e-9), 6)


def value_text(df: DataFrame, name: str) -> Column:
    """A value as text that does not depend on an engine's number formats."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, DoubleType):
        return F.round(round6(c) * 1_000_000).cast("bigint").cast("string")
    if isinstance(kind, (TimestampNTZType, TimestampType)):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    if isinstance(kind, DateType):
        return F.date_diff(c, F.lit("1970-01-01").cast("date")).cast("string")
    assert isinstance(kind, (NumericType, BooleanType)) or kind.simpleString() == "string", (name, kind)
    return c.cast("string")


def column_digests(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, rows, filled, digest): a row for each column, in
    one pass. ``digest`` adds up 32 bits of each value's MD5, so the order and the
    files of the rows do not matter, and a changed, lost or doubled value does."""
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(df.columns):
        text = value_text(df, name)
        part = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(38,0)")
        measures += [F.count(text).alias(f"filled_{i}"), (F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")) % F.lit(10 ** 15)).cast("bigint").alias(f"digest_{i}")]
    rows = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(n).alias("column_name"), F.col("rows"), F.col(f"filled_{i}").alias("filled"),
                              F.col(f"digest_{i}").alias("digest")) for i, n in enumerate(df.columns)])
    return df.agg(*measures).select(F.inline(rows))
