"""Data-quality checks D1-D4 and segment recommendations R1-R2."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import literal_table
from .metrics import funnel_metrics

ROW_COUNT_TABLES = ("clean_users", "clean_sessions", "clean_events", "clean_orders")
DROPOFF_ALERT = 0.75


def row_counts(T: Mapping[str, DataFrame], tables=ROW_COUNT_TABLES) -> DataFrame:
    """(check, value) = (<table>_rows, COUNT(*)) per clean table."""
    out = None
    for t in tables:
        p = T[t].agg(F.count(F.lit(1)).alias("value")).select(F.lit(f"{t}_rows").alias("check"), "value")
        out = p if out is None else out.unionByName(p)
    return out


def observed(spark, measures: Mapping[str, int]) -> DataFrame:
    """(check, value) of measures that were taken while tables were written."""
    return literal_table(spark, list(measures.items()), [("check", "string"), ("value", "bigint")])


def duplicate_ids(df: DataFrame, key: str, label: str) -> DataFrame:
    """COUNT(*) - COUNT(DISTINCT key)."""
    return df.agg((F.count(F.lit(1)) - F.countDistinct(key)).alias("value")).select(
        F.lit(label).alias("check"), "value")


def missing_values(df: DataFrame, col: str, label: str) -> DataFrame:
    """D3: number of NULLs in ``col``."""
    return df.agg(F.count_if(F.col(col).isNull()).alias("value")).select(
        F.lit(label).alias("check"), "value")


def data_quality(T: Mapping[str, DataFrame], raw: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """D1-D3 as (check, value) rows: on the clean tables as the shop does, and
    on the raw events too when given (where they can be non-zero)."""
    out = row_counts(T)
    out = out.unionByName(duplicate_ids(T["clean_events"], "event_id", "duplicate_events"))
    out = out.unionByName(missing_values(T["clean_events"], "event_timestamp", "missing_event_timestamps"))
    if raw is not None:
        out = out.unionByName(duplicate_ids(raw["raw_events"], "event_id", "raw_duplicate_events"))
        out = out.unionByName(missing_values(raw["raw_events"], "event_timestamp", "raw_missing_event_timestamps"))
    return out


def suspicious_drops(T: Mapping[str, DataFrame], threshold: float = DROPOFF_ALERT) -> DataFrame:
    """Unfiltered funnel steps whose dropoff rate exceeds ``threshold``."""
    return funnel_metrics(T).where(F.col("dropoff_rate") > F.lit(threshold)).select("event_name", "dropoff_rate")


def segment_slice(segments: DataFrame, segment_type: str = "device_type",
                  segment_value: str = "mobile") -> DataFrame:
    """Rows of one segment (mobile evidence by default)."""
    return segments.where((F.col("segment_type") == segment_type) & (F.col("segment_value") == segment_value))


def lowest_segments(segments: DataFrame, k: int = 3) -> DataFrame:
    """R2: the k lowest conversion rates across all segment types, NULLs last.
    A top-k: Spark plans it as TakeOrderedAndProject (per-task top-k, then merge)."""
    return segments.orderBy(F.col("conversion_rate").asc_nulls_last(), F.col("segment_type"),
                            F.col("segment_value")).limit(k)
