"""Gold marts G1-G5 over the clean tables ``T`` (dict of DataFrames).

Also the segment aggregates shared with the filtered metric queries
(M5, M6 reuse ``experiment_aggregate`` / ``segment_aggregate``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import (SESSION_DIMS, USER_DIMS, apply_filters, explode_segments, filtered_session_users, literal_table, safe_div, sort_small,
                   with_order_stats)

# The ordered funnel step list.
FUNNEL_STEPS = (
    ("homepage_view", 1),
    ("search", 2),
    ("product_view", 3),
    ("add_to_basket", 4),
    ("checkout_start", 5),
    ("payment_complete", 6),
)

# Segmentations of the experiment mart (4) and of the
# filtered experiment query (6), and of segment performance (5).
GOLD_EXPERIMENT_SEGMENTS = (("overall", None), ("device_type", "device_type"),
                            ("customer_type", "customer_type"), ("channel", "channel"))
EXPERIMENT_SEGMENTS = (("overall", None), ("device_type", "device_type"), ("region", "region"),
                       ("customer_type", "customer_type"), ("loyalty_flag", "loyalty_flag"),
                       ("channel", "channel"))
SEGMENT_TYPES = (("device_type", "device_type"), ("region", "region"),
                 ("customer_type", "customer_type"), ("loyalty_flag", "loyalty_flag"),
                 ("channel", "channel"))


# --------------------------------------------------------------------- G1 / M7
def daily_kpis_from(sessions: DataFrame, orders: DataFrame, sessions_unique: bool) -> DataFrame:
    """Per calendar day: sessions and active users from ``sessions`` (by
    session_start), orders / revenue / mean revenue from ``orders`` (by
    order_timestamp); LEFT JOIN from the session days, zeros for no orders.

    ``sessions_unique``: every row is a distinct session, so
    COUNT(DISTINCT session_id) is a plain count (one distinct aggregate less).
    """
    sess_count = F.count("session_id") if sessions_unique else F.countDistinct("session_id")
    ds = sessions.groupBy(F.to_date("session_start").alias("event_date")).agg(
        sess_count.alias("sessions"), F.countDistinct("user_id").alias("active_users"))
    do = orders.groupBy(F.to_date("order_timestamp").alias("event_date")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue"),
        F.avg("revenue").alias("average_order_value"))
    orders_c = F.coalesce(F.col("orders"), F.lit(0))
    # Both sides are one row per day; AQE broadcasts the measured-small side.
    return (ds.join(do, "event_date", "left")
              .select("event_date", "sessions", "active_users",
                      orders_c.alias("orders"),
                      F.coalesce(F.col("revenue"), F.lit(0.0)).alias("revenue"),
                      F.coalesce(F.col("average_order_value"), F.lit(0.0)).alias("average_order_value"),
                      safe_div(orders_c, F.col("sessions")).alias("conversion_rate"))
              .transform(lambda d: sort_small(d, "event_date")))


def gold_daily_kpis(T: Mapping[str, DataFrame]) -> DataFrame:
    """G1: no user join, so order-only days vanish and all sessions count."""
    return daily_kpis_from(T["clean_sessions"], T["clean_orders"], sessions_unique=True)


# --------------------------------------------------------------------- G2 / M4
def funnel_steps(spark: SparkSession, steps: Sequence[tuple[str, int]] = FUNNEL_STEPS) -> DataFrame:
    return literal_table(spark, steps, [("event_name", "string"), ("step_order", "int")])


def funnel_from(events: DataFrame, steps: DataFrame, step_names: Sequence[str]) -> DataFrame:
    """Distinct sessions per step (any event of that name, order in time
    ignored), left-joined from the step list; rates against the first and the
    previous step (NULL on zero denominators)."""
    counts = (events.where(F.col("event_name").isin(*step_names))
                    .groupBy("event_name").agg(F.countDistinct("session_id").alias("sessions")))
    # The step list is a fixed handful of rows: broadcasting it is size-bounded.
    w = Window.orderBy("step_order")
    sess = F.coalesce(F.col("sessions"), F.lit(0))
    prev = F.lag(sess).over(w)
    return (F.broadcast(steps).join(counts, "event_name", "left")
              .select("event_name", "step_order", sess.alias("sessions"),
                      safe_div(sess, F.first_value(sess).over(w)).alias("conversion_from_start"),
                      safe_div(sess, prev).alias("step_conversion_rate"),
                      (F.lit(1.0) - safe_div(sess, prev)).alias("dropoff_rate"))
              .transform(lambda d: sort_small(d, "step_order")))


def gold_funnel_metrics(T: Mapping[str, DataFrame], steps: Sequence[tuple[str, int]] = FUNNEL_STEPS) -> DataFrame:
    """G2 over all clean events."""
    spark = T["clean_events"].sparkSession
    return funnel_from(T["clean_events"].select("event_name", "session_id"),
                       funnel_steps(spark, steps), [s for s, _ in steps])


# ------------------------------------------------------------------- G3 / M5
def experiment_base(T: Mapping[str, DataFrame], filters: Mapping | None = None,
                    experiment_name: str | None = None) -> DataFrame:
    """Sessions with their orders, summed to one row per (user, device, channel),
    then joined to users and to assignments (on user only: the reference does
    not filter the experiment; ``experiment_name`` optionally restricts it).

    The sums are combined map-side before the user join, so a user with a third
    of all sessions arrives there as a handful of rows. Sessions are unique
    after Silver, so their number is a count."""
    a = T["clean_experiment_assignments"]
    if experiment_name is not None:
        a = a.where(F.col("experiment_name") == F.lit(experiment_name))
    s = apply_filters(T["clean_sessions"].select("session_id", "user_id", "device_type", "channel"), filters, SESSION_DIMS)
    u = apply_filters(T["clean_users"].select("user_id", "region", "customer_type", "loyalty_flag"), filters, USER_DIMS)
    per_user = (with_order_stats(s, T["clean_orders"]).groupBy("user_id", "device_type", "channel")
                .agg(F.count(F.lit(1)).alias("sessions"), F.sum("conversions").alias("conversions"),
                     F.sum("revenue").alias("revenue"), F.sum("nonzero_orders").alias("nonzero_orders")))
    return per_user.join(u, "user_id").join(a.select("user_id", "variant"), "user_id")


def experiment_aggregate(base: DataFrame, segments) -> DataFrame:
    """Per (segment_type, segment_value, variant): distinct sessions, sum of
    conversions (orders, Q-2), rate, revenue, mean non-zero order revenue.

    Repeated user or assignment rows repeat a (user, device, channel) row: its
    orders then count again, as in the reference's join, while its distinct
    sessions count once per segment and variant (the max of equal counts)."""
    own = ["user_id", "device_type", "channel"]
    seg = explode_segments(base, segments)
    keys = ["segment_type", "segment_value", "variant"]
    per_user = (seg.groupBy(*keys, *own).agg(
        F.max("sessions").alias("s"), F.sum("conversions").alias("c"),
        F.sum("revenue").alias("r"), F.sum("nonzero_orders").alias("nz")))
    sessions, conv = F.sum("s"), F.sum("c")
    return per_user.groupBy(*keys).agg(
        sessions.alias("sessions"),
        conv.alias("conversions"),
        safe_div(conv, sessions).alias("conversion_rate"),
        F.sum("r").alias("revenue"),
        safe_div(F.sum("r"), F.sum("nz")).alias("avg_order_value"),
    )


def gold_experiment_results(T: Mapping[str, DataFrame]) -> DataFrame:
    """Four segmentations (overall, device_type, customer_type, channel)."""
    return experiment_aggregate(experiment_base(T), GOLD_EXPERIMENT_SEGMENTS)


# ------------------------------------------------------------------- G4 / M6
def segment_aggregate(base: DataFrame, segments=SEGMENT_TYPES) -> DataFrame:
    """Per (segment_type, segment_value): distinct sessions and users, orders,
    rate, revenue, mean non-zero order revenue.

    Two distinct counts would make Spark triple the rows (Expand); instead the
    distinctness is made explicit in levels -- (segment, session) rows first
    (this level reuses the session_id partitioning of the order join), then
    (segment, user), then the segment -- exact because a session carries one
    user id."""
    seg = explode_segments(base.select("session_id", "user_id", "device_type", "channel", "region",
                                       "customer_type", "loyalty_flag", "conversions", "revenue",
                                       "nonzero_orders"), segments)
    keys = ["segment_type", "segment_value"]
    per_session = seg.groupBy(*keys, "session_id", "user_id").agg(
        F.sum("conversions").alias("c"), F.sum("revenue").alias("r"), F.sum("nonzero_orders").alias("nz"))
    per_user = per_session.groupBy(*keys, "user_id").agg(
        F.count(F.lit(1)).alias("s"), F.sum("c").alias("c"), F.sum("r").alias("r"), F.sum("nz").alias("nz"))
    sessions = F.sum("s")
    conv = F.sum("c")
    return per_user.groupBy(*keys).agg(
        sessions.alias("sessions"),
        F.count(F.lit(1)).alias("users"),
        conv.alias("orders"),
        safe_div(conv, sessions).alias("conversion_rate"),
        F.sum("r").alias("revenue"),
        safe_div(F.sum("r"), F.sum("nz")).alias("average_order_value"),
    )


def segment_base(T: Mapping[str, DataFrame], filters: Mapping | None = None) -> DataFrame:
    return with_order_stats(filtered_session_users(T, filters), T["clean_orders"])


def gold_segment_performance(T: Mapping[str, DataFrame]) -> DataFrame:
    """Five segmentations, loyalty as text."""
    return segment_aggregate(segment_base(T))


# ------------------------------------------------------------------------ G5
def gold_product_performance(T: Mapping[str, DataFrame]) -> DataFrame:
    """Every product LEFT JOIN its events: distinct sessions with any event
    on the product, distinct add-to-basket sessions, mean price and margin.

    Events are reduced to (product, session) pairs and then to one row per
    product before the join, so the join is product-sized."""
    pairs = (T["clean_events"].where(F.col("product_id").isNotNull() & F.col("session_id").isNotNull())
             .groupBy("product_id", "session_id")
             .agg(F.max((F.col("event_name") == "add_to_basket").cast("int")).alias("basket")))
    per_product = pairs.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("product_view_sessions"),
        F.sum("basket").alias("add_to_basket_sessions"))
    # Duplicate product rows of one (id, name, category) each join the same
    # events, so the mean over joined rows equals the mean over product rows.
    prods = T["clean_products"].groupBy("product_id", "product_name", "category").agg(
        F.avg("base_price").alias("average_price"), F.avg("margin_rate").alias("margin_rate"))
    return prods.join(per_product, "product_id", "left").select(
        "product_id", "product_name", "category",
        F.coalesce(F.col("product_view_sessions"), F.lit(0)).alias("product_view_sessions"),
        F.coalesce(F.col("add_to_basket_sessions"), F.lit(0)).cast("bigint").alias("add_to_basket_sessions"),
        "average_price", "margin_rate")


GOLD_BUILDERS = {
    "gold_daily_kpis": gold_daily_kpis,
    "gold_funnel_metrics": gold_funnel_metrics,
    "gold_experiment_results": gold_experiment_results,
    "gold_segment_performance": gold_segment_performance,
    "gold_product_performance": gold_product_performance,
}


def gold_tables(T: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All five marts (planned lazily, on first access)."""
    from ..sources.fixtures import LazyFrames
    return LazyFrames({name: (lambda fn=fn: fn(T)) for name, fn in GOLD_BUILDERS.items()})
