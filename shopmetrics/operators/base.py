"""Shared building blocks of the Gold marts and filtered metrics: the
dimension filter (M1), per-session order statistics and the segment fan-out.

Scale notes
* Orders are pre-aggregated to one row per session (count, revenue sum,
  non-zero count) *before* they meet the session base, so the one-to-many
  left join of the reference never fans rows out; the fan-out semantics
  (a session with two orders converts twice) are kept by summing counts.
* The segment fan-out is one generator (``inline`` over an array of
  (type, value) structs): one scan of the base instead of one per UNION ALL
  branch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dimension -> owning entity (session or user), and the "no filter" sentinel.
SESSION_DIMS = ("device_type", "channel")
USER_DIMS = ("region", "customer_type", "loyalty_flag")
FILTER_DIMS = ("device_type", "channel", "region", "customer_type", "loyalty_flag")
ALL = "All"


def active_filters(filters: Mapping | None) -> dict:
    """M1: drop absent, None and "All" entries; keep only the five known dims."""
    filters = filters or {}
    return {d: filters[d] for d in FILTER_DIMS
            if d in filters and filters[d] is not None and filters[d] != ALL}


def filter_predicate(filters: Mapping | None, dims: Sequence[str] = FILTER_DIMS) -> Column | None:
    """M1: conjunctive equality predicate over the active filters restricted to
    ``dims``; values are bound as literals (no SQL text is built)."""
    pred = None
    for d, v in active_filters(filters).items():
        if d not in dims:
            continue
        if d == "loyalty_flag" and isinstance(v, str):
            v = v.strip().lower() == "true"
        c = F.col(d) == F.lit(v)
        pred = c if pred is None else (pred & c)
    return pred


def apply_filters(df: DataFrame, filters: Mapping | None, dims: Sequence[str] = FILTER_DIMS) -> DataFrame:
    pred = filter_predicate(filters, dims)
    return df if pred is None else df.where(pred)


def filtered_session_users(T: Mapping[str, DataFrame], filters: Mapping | None = None) -> DataFrame:
    """clean_sessions JOIN clean_users ON user_id, filtered (the reference's
    metric base). Session dims filter the session side and user dims the user
    side, so each predicate sits right above its scan."""
    s = apply_filters(T["clean_sessions"].select("session_id", "user_id", "session_start",
                                                 "device_type", "channel"), filters, SESSION_DIMS)
    u = apply_filters(T["clean_users"].select("user_id", "region", "customer_type", "loyalty_flag"),
                      filters, USER_DIMS)
    return s.join(u, "user_id")


def eligible_sessions(T: Mapping[str, DataFrame], filters: Mapping | None = None) -> DataFrame:
    """Distinct session ids that survive the session x user join and filter.

    Used as the right side of a LEFT SEMI join wherever the reference only
    counts DISTINCT sessions: a semi join cannot multiply rows, so user
    duplicates never inflate the work."""
    s = apply_filters(T["clean_sessions"].select("session_id", "user_id", "session_start",
                                                 "device_type", "channel"), filters, SESSION_DIMS)
    u = apply_filters(T["clean_users"].select("user_id", "region", "customer_type", "loyalty_flag"),
                      filters, USER_DIMS).select("user_id")
    return s.join(u, "user_id", "left_semi").select("session_id", "user_id", "session_start")


def session_order_stats(orders: DataFrame) -> DataFrame:
    """One row per session: number of orders, revenue sum and number of
    non-zero-revenue orders (clean orders have revenue >= 0 and not NULL)."""
    return orders.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("revenue").alias("rev_sum"),
        F.count(F.when(F.col("revenue") != 0, F.lit(1))).alias("n_nonzero"),
    )


def with_order_stats(base: DataFrame, orders: DataFrame) -> DataFrame:
    """Left join per-session order statistics and turn them into the measures
    of the reference's ``LEFT JOIN clean_orders``: a base row without orders
    stands for one joined row with converted=0 and revenue 0."""
    st = session_order_stats(orders)
    return base.join(st, "session_id", "left").select(
        *base.columns,
        F.coalesce(F.col("n_orders"), F.lit(0)).alias("conversions"),
        F.coalesce(F.col("rev_sum"), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.col("n_nonzero"), F.lit(0)).alias("nonzero_orders"))


def explode_segments(df: DataFrame, segments: Sequence[tuple[str, Column | str | None]]) -> DataFrame:
    """Fan each row out into (segment_type, segment_value) rows. A segment
    given with ``None`` maps to a constant 'all' value (the overall row)."""
    items = []
    for seg_type, value in segments:
        if value is None:
            v = F.lit("all")
        else:
            v = (F.col(value) if isinstance(value, str) else value).cast("string")
        items.append(F.struct(F.lit(seg_type).alias("segment_type"), v.alias("segment_value")))
    return (df.select("*", F.inline(F.array(*items))))


def safe_div(num: Column, den: Column) -> Column:
    """num / NULLIF(den, 0) as DOUBLE (ANSI mode raises on x/0)."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def sort_small(df: DataFrame, *cols) -> DataFrame:
    """ORDER BY for a result of bounded cardinality (calendar days, funnel
    steps, segment values): gathered into one partition and sorted there,
    which skips the sampling job of a range-partitioned global sort. Only for
    aggregated marts -- never for entity-sized tables."""
    return df.coalesce(1).sortWithinPartitions(*cols)


def literal_table(spark, rows, schema: Sequence[tuple[str, str]]) -> DataFrame:
    """A small fixed table (step lists, option lists) as inline literals: a
    JVM-side local relation, no Python worker and no RDD."""
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, schema)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
