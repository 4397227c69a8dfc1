"""Silver cleaners (S1-S6): casts, key filters, lower-cased categories and
first-row-per-key deduplication.

Dedup is ``row_number() OVER (PARTITION BY key ORDER BY ts NULLS LAST, tiebreak)
= 1``. Spark plans that as a *partial* ``WindowGroupLimit`` before the shuffle
and a final one after it, so a key that holds a large share of all rows is cut
to one row per map task before anything is exchanged (map-side combine), and
the sort after the shuffle only sees the survivors. The alternative
``groupBy(key).agg(min_by(struct(*), order))`` measured the same at sf0.1
(0.5-0.7 s warm for raw events) and plans a sort-based aggregate anyway
(struct buffers do not fit the hash aggregate), so the declarative window form
is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order_col: str,
                  tiebreak: Sequence[str] = ()) -> DataFrame:
    """Keep the earliest row per ``keys`` by ``order_col`` (NULLs last).

    ``tiebreak`` columns make the choice repeatable when timestamps tie.
    """
    order: list[Column] = [F.col(order_col).asc_nulls_last()]
    # All other columns come last, so that full ties are rows with equal values.
    order += [F.col(c).asc_nulls_last() for c in [*tiebreak, *(c for c in df.columns if c not in {*keys, order_col, *tiebreak})]]
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") == 1)
              .drop("_rn"))


def tolerant_bigint(col: Column) -> Column:
    """TRY_CAST to BIGINT that accepts float text ('12.0' -> 12, '12.7' -> 13,
    '' or 'x' -> NULL), matching a SQL engine that rounds float strings."""
    exact = col.try_cast("bigint")
    rounded = F.round(col.try_cast("decimal(38,18)"), 0).try_cast("bigint")  # half away from zero
    return F.coalesce(exact, rounded)


def clean_users(raw: DataFrame) -> DataFrame:
    """Casts and non-null key; no dedup and no lower-casing."""
    return raw.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("region").cast("string").alias("region"),
        F.col("customer_type").cast("string").alias("customer_type"),
        F.col("loyalty_flag").cast("boolean").alias("loyalty_flag"),
        F.col("signup_date").cast("date").alias("signup_date"),
    ).where(F.col("user_id").isNotNull())


def clean_products(raw: DataFrame) -> DataFrame:
    """Casts and non-null key; no dedup."""
    return raw.select(
        F.col("product_id").cast("bigint").alias("product_id"),
        F.col("product_name").cast("string").alias("product_name"),
        F.col("category").cast("string").alias("category"),
        F.col("base_price").cast("double").alias("base_price"),
        F.col("margin_rate").cast("double").alias("margin_rate"),
    ).where(F.col("product_id").isNotNull())


def clean_sessions(raw: DataFrame) -> DataFrame:
    """S3: lower device/channel; earliest row per session_id."""
    df = raw.select(
        F.col("session_id").cast("bigint").alias("session_id"),
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("session_start").cast("timestamp_ntz").alias("session_start"),
        F.lower("device_type").alias("device_type"),
        F.lower("channel").alias("channel"),
    ).where(F.col("session_id").isNotNull())
    return first_per_key(df, ["session_id"], "session_start",
                         tiebreak=["user_id", "device_type", "channel"])


def clean_events(raw: DataFrame) -> DataFrame:
    """Lower names and dims, tolerant product id cast; key and timestamp
    non-null (filtered before dedup); earliest row per event_id."""
    df = raw.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("session_id").cast("bigint").alias("session_id"),
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"),
        F.lower("event_name").alias("event_name"),
        tolerant_bigint(F.col("product_id").cast("string")).alias("product_id"),
        F.lower("device_type").alias("device_type"),
        F.col("region").cast("string").alias("region"),
        F.col("customer_type").cast("string").alias("customer_type"),
        F.col("loyalty_flag").cast("boolean").alias("loyalty_flag"),
        F.lower("channel").alias("channel"),
    ).where(F.col("event_id").isNotNull() & F.col("event_timestamp").isNotNull())
    return first_per_key(df, ["event_id"], "event_timestamp",
                         tiebreak=["event_name", "session_id", "product_id"])


def clean_orders(raw: DataFrame) -> DataFrame:
    """Lower device/channel/variant; key non-null and revenue >= 0 (NULL
    revenue drops too); earliest row per order_id."""
    df = raw.select(
        F.col("order_id").cast("bigint").alias("order_id"),
        F.col("session_id").cast("bigint").alias("session_id"),
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("order_timestamp").cast("timestamp_ntz").alias("order_timestamp"),
        F.col("revenue").cast("double").alias("revenue"),
        F.col("basket_value").cast("double").alias("basket_value"),
        F.col("items_count").cast("bigint").alias("items_count"),
        F.lower("device_type").alias("device_type"),
        F.col("region").cast("string").alias("region"),
        F.col("customer_type").cast("string").alias("customer_type"),
        F.col("loyalty_flag").cast("boolean").alias("loyalty_flag"),
        F.lower("channel").alias("channel"),
        F.lower("variant").alias("variant"),
    ).where(F.col("order_id").isNotNull() & (F.col("revenue") >= 0))
    return first_per_key(df, ["order_id"], "order_timestamp",
                         tiebreak=["session_id", "revenue"])


def clean_experiment_assignments(raw: DataFrame) -> DataFrame:
    """Lower variant; earliest assignment per (user_id, experiment_name)."""
    df = raw.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("experiment_name").cast("string").alias("experiment_name"),
        F.lower("variant").alias("variant"),
        F.col("assigned_at").cast("timestamp_ntz").alias("assigned_at"),
    ).where(F.col("user_id").isNotNull())
    return first_per_key(df, ["user_id", "experiment_name"], "assigned_at",
                         tiebreak=["variant"])


CLEANERS = {
    "clean_users": ("raw_users", clean_users),
    "clean_products": ("raw_products", clean_products),
    "clean_sessions": ("raw_sessions", clean_sessions),
    "clean_events": ("raw_events", clean_events),
    "clean_orders": ("raw_orders", clean_orders),
    "clean_experiment_assignments": ("raw_experiment_assignments", clean_experiment_assignments),
}


def silver_tables(raw) -> dict[str, DataFrame]:
    """Apply every cleaner to its raw entity (lazily: a cleaner is planned
    only when its table is asked for)."""
    from ..sources.fixtures import LazyFrames
    return LazyFrames({name: (lambda fn=fn, src=src: fn(raw[src])) for name, (src, fn) in CLEANERS.items()})
