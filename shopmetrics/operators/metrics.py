"""Filtered metric queries M2-M9 over the clean tables ``T``.

``filters`` is a dict over device_type, channel, region, customer_type and
loyalty_flag; absent, None or "All" means no filter (M1, see ``base``).
Device and channel bind to the session, the other three to the user; every
query inner-joins sessions to users, so sessions without a user drop.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import gold as G
from .base import (ALL, SESSION_DIMS, USER_DIMS, active_filters, apply_filters, eligible_sessions, literal_table, safe_div,
                   session_order_stats, sort_small)

# Fixed value: the loyalty options are listed, not queried.
LOYALTY_OPTIONS = (ALL, True, False)
TEXT_OPTION_DIMS = (("device_type", "clean_sessions"), ("region", "clean_users"),
                    ("customer_type", "clean_users"), ("channel", "clean_sessions"))


# ------------------------------------------------------------------------ M2
def filter_options(T: Mapping[str, DataFrame]) -> DataFrame:
    """(dimension, value, position): "All" first, then the sorted distinct
    values of the four text dims; loyalty is the fixed [All, True, False].
    One scan per table emits (dimension, value) pairs; the rank is a window
    partitioned by dimension."""
    spark = T["clean_sessions"].sparkSession
    by_table: dict[str, list[str]] = {}
    for dim, table in TEXT_OPTION_DIMS:
        by_table.setdefault(table, []).append(dim)
    pairs = None
    for table, dims in by_table.items():
        p = T[table].select(F.inline(F.array(*[
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])))
        pairs = p if pairs is None else pairs.unionByName(p)
    w = Window.partitionBy("dimension").orderBy(F.col("value").asc_nulls_last())
    ranked = pairs.distinct().select("dimension", "value", F.dense_rank().over(w).cast("int").alias("position"))
    fixed = [(d, ALL, 0) for d, _ in TEXT_OPTION_DIMS]
    fixed += [("loyalty_flag", str(v) if v == ALL else str(v).lower(), i) for i, v in enumerate(LOYALTY_OPTIONS)]
    out = literal_table(spark, fixed, [("dimension", "string"), ("value", "string"), ("position", "int")])
    return out.unionByName(ranked)


# ------------------------------------------------------------------------ M3
def _overall_uplift(T: Mapping[str, DataFrame], experiment: DataFrame | None = None) -> DataFrame:
    """One row: variant minus control conversion rate of the *unfiltered*
    experiment mart's overall rows (0 when a variant is missing). Only the
    overall segmentation is computed (the same rows as G3's overall rows)."""
    exp = experiment if experiment is not None else G.experiment_aggregate(
        G.experiment_base(T), [("overall", None)])
    overall = exp.where((F.col("segment_type") == "overall") & (F.col("segment_value") == "all"))
    return overall.agg(F.coalesce(
        F.max(F.when(F.col("variant") == "variant", F.col("conversion_rate")))
        - F.max(F.when(F.col("variant") == "control", F.col("conversion_rate"))), F.lit(0.0)).alias("experiment_uplift"))


def _session_measures(T: Mapping[str, DataFrame], filters: Mapping | None, orders: DataFrame | None = None) -> DataFrame:
    """One row for each session that survives the join with users and the filter:
    its columns, ``user_rows`` (rows of its user) and those of ``orders`` (one row
    for each session; by default the order sums)."""
    users = apply_filters(T["clean_users"], filters, USER_DIMS).groupBy("user_id").agg(F.count(F.lit(1)).alias("user_rows"))
    sessions = apply_filters(T["clean_sessions"].select("session_id", "user_id", "session_start", "device_type", "channel"), filters, SESSION_DIMS)
    # Sessions and orders are both stored by session: they meet first, without an exchange.
    return sessions.join(orders if orders is not None else session_order_stats(T["clean_orders"]), "session_id", "left").join(users, "user_id")


def executive_metrics(T: Mapping[str, DataFrame], filters: Mapping | None = None,
                      experiment: DataFrame | None = None) -> DataFrame:
    """One row: revenue, orders, conversion_rate, average_order_value,
    active_users, experiment_uplift (from the *unfiltered* experiment mart's
    overall rows) and commercial_impact_estimate = uplift x sessions x AOV."""
    # One base for both sides: a row for each eligible session, with its orders'
    # sums and the number of its user's rows, by which the join of the reference
    # (orders x sessions x users) repeats them.
    base = _session_measures(T, filters)
    one = base.agg(F.count(F.lit(1)).alias("sessions"), F.countDistinct("user_id").alias("active_users"),
                   F.coalesce(F.sum(F.col("n_orders") * F.col("user_rows")), F.lit(0)).alias("orders"), F.sum(F.col("rev_sum") * F.col("user_rows")).alias("revenue_sum"))
    one = one.withColumn("aov", safe_div(F.col("revenue_sum"), F.col("orders")))
    uplift = _overall_uplift(T, experiment)
    up = F.col("experiment_uplift")
    aov = F.coalesce(F.col("aov"), F.lit(0.0))
    # Two one-row frames: the cross join is 1 x 1.
    return one.crossJoin(uplift).select(
        F.coalesce(F.col("revenue_sum"), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.col("orders"), F.lit(0)).alias("orders"),
        F.when(F.col("sessions") == 0, F.lit(0.0))
         .otherwise(F.col("orders").cast("double") / F.col("sessions")).alias("conversion_rate"),
        aov.alias("average_order_value"),
        F.col("active_users"),
        up.alias("experiment_uplift"),
        (up * F.col("sessions") * aov).alias("commercial_impact_estimate"),
    )


# ------------------------------------------------------------------------ M4
def funnel_metrics(T: Mapping[str, DataFrame], filters: Mapping | None = None,
                   steps: Sequence[tuple[str, int]] = G.FUNNEL_STEPS) -> DataFrame:
    """G2 over events of eligible sessions; afterwards NULL step rate -> 1.0
    and NULL dropoff -> 0.0 (also when the previous step has 0 sessions)."""
    ev = T["clean_events"].select("event_name", "session_id")
    ev = ev.join(eligible_sessions(T, filters).select("session_id"), "session_id", "left_semi")
    spark = ev.sparkSession
    f = G.funnel_from(ev, G.funnel_steps(spark, steps), [s for s, _ in steps])
    return f.fillna({"step_conversion_rate": 1.0, "dropoff_rate": 0.0})


# ------------------------------------------------------------------------ M5
def experiment_results(T: Mapping[str, DataFrame], filters: Mapping | None = None,
                       experiment_name: str | None = None) -> DataFrame:
    """G3 with six segmentations (adds region and loyalty_flag as text),
    filtered, ordered by segment_type, segment_value, variant."""
    base = G.experiment_base(T, filters, experiment_name)
    return sort_small(G.experiment_aggregate(base, G.EXPERIMENT_SEGMENTS),
                      "segment_type", "segment_value", "variant")


# ------------------------------------------------------------------------ M6
def segment_performance(T: Mapping[str, DataFrame], filters: Mapping | None = None) -> DataFrame:
    """G4 filtered; ordered by segment_type, conversion_rate DESC."""
    return sort_small(G.segment_aggregate(G.segment_base(T, filters)),
                      F.col("segment_type").asc(), F.col("conversion_rate").desc_nulls_last(),
                      F.col("segment_value").asc())


# ------------------------------------------------------------------------ M7
def daily_kpis(T: Mapping[str, DataFrame], filters: Mapping | None = None) -> DataFrame:
    """G1 with both sides filtered and joined to users: orders must join a
    session and its user."""
    # Orders by session and day, as a list at each session (as long as its days),
    # so that one pass over the sessions gives both sides of the report.
    by_day = (T["clean_orders"].groupBy("session_id", F.to_date("order_timestamp").alias("day"))
              .agg(F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue"))
              .groupBy("session_id").agg(F.collect_list(F.struct("day", "orders", "revenue")).alias("days")))
    base = _session_measures(T, filters, by_day)
    start = F.to_date("session_start")

    def fact(day, user, sessions, orders, revenue):
        return F.struct(day.alias("event_date"), user.alias("user"), sessions.alias("sessions"), orders.alias("orders"), revenue.alias("revenue"))
    none = F.lit(0).cast("bigint")
    own = F.array(fact(start, F.col("user_id"), F.lit(1).cast("bigint"), none, F.lit(0.0)))
    ordered = F.transform(F.col("days"), lambda d: fact(d["day"], F.lit(None).cast("bigint"), none, d["orders"] * F.col("user_rows"), d["revenue"] * F.col("user_rows")))
    facts = base.select(F.inline(F.concat(own, F.coalesce(ordered, F.slice(own, 1, 0)))))
    days = facts.groupBy("event_date").agg(F.sum("sessions").alias("sessions"), F.countDistinct("user").alias("active_users"),
                                           F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"))
    # Days with orders only are not in the report.
    return sort_small(days.where("sessions > 0").select(
        "event_date", "sessions", "active_users", "orders", "revenue",
        F.coalesce(safe_div(F.col("revenue"), F.col("orders")), F.lit(0.0)).alias("average_order_value"),
        safe_div(F.col("orders"), F.col("sessions")).alias("conversion_rate")), "event_date")


# ------------------------------------------------------------------------ M8
def metric_context(T: Mapping[str, DataFrame], prepare=None, experiment: DataFrame | None = None) -> DataFrame:
    """M3 + M4 + M5 + M6 (unfiltered) as one tall frame (section, payload
    JSON with NULL fields kept). Each part is a small result, never a raw
    table. ``prepare`` optionally maps each part first (e.g. rounding)."""
    parts = {
        "executive": executive_metrics(T, experiment=experiment),
        "funnel": funnel_metrics(T),
        "experiment": experiment_results(T),
        "segments": segment_performance(T),
    }
    out = None
    for name, df in parts.items():
        if prepare is not None:
            df = prepare(df)
        p = df.select(F.lit(name).alias("section"),
                      F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("payload"))
        out = p if out is None else out.unionByName(p)
    return out


# ------------------------------------------------------------------------ M9
# Fixed value: the dashboard lists its filters in this order (filter text order).
SIDEBAR_ORDER = ("device_type", "region", "customer_type", "loyalty_flag", "channel")


def filter_text(filters: Mapping | None = None) -> str:
    """N7 for one selection: the active filters in the order of the dashboard."""
    active = active_filters(filters)
    parts = [f"{d.replace('_', ' ')} = {active[d]}" for d in SIDEBAR_ORDER if d in active]
    return "Active filters: " + (", ".join(parts) or "All traffic")


def kpi_cube(T: Mapping[str, DataFrame], dims: Sequence[str] = SIDEBAR_ORDER,
             experiment: DataFrame | None = None) -> DataFrame:
    """Every filter combination of the dashboard in one pass: the M3 KPIs
    (sessions, active users, orders, revenue, AOV, conversion) for each slice of
    ``dims`` where a rolled-up dim reads "All", plus the active-filter text (N7).

    Pre-aggregation keeps the cube small: orders collapse to one row per
    session, sessions to one row per (dims, user), and those to one row per
    (dims, 32,768 users) before the 2^d expansion. Distinct sessions are summed per (dims, user),
    which is exact while each session carries one set of dim values (sessions
    are unique after Silver; user rows of one id agree on their dims)."""
    # Orders meet sessions (both keyed by session_id), then sessions are summed
    # per user and session dims with map-side combine: a hot user reaches the
    # join with users as a few rows.
    sess_dims = [d for d in dims if d in ("device_type", "channel")]
    user_dims = [d for d in dims if d not in sess_dims]
    st = session_order_stats(T["clean_orders"])
    per_own = (T["clean_sessions"].select("session_id", "user_id", *sess_dims)
               .join(st, "session_id", "left").groupBy("user_id", *sess_dims).agg(
                   F.count(F.lit(1)).alias("s"),
                   F.sum(F.coalesce(F.col("n_orders"), F.lit(0))).alias("o"),
                   F.sum(F.coalesce(F.col("rev_sum"), F.lit(0.0))).alias("r")))
    per_user = per_own.join(T["clean_users"].select("user_id", *user_dims), "user_id").groupBy(*dims, "user_id").agg(
        F.max("s").alias("sessions"), F.sum("o").alias("orders"), F.sum("r").alias("revenue"))
    # Distinct users by bitmaps: 32,768 ids to a bucket. The grouping sets merge the
    # bitmaps and sums of (dims, bucket), and no row of a user is expanded. Ids need
    # not be dense for that, but dense ones fill the bitmaps.
    finest = (per_user.withColumn("_bucket", F.bitmap_bucket_number("user_id")).groupBy(*dims, "_bucket").agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("_users"), F.sum("sessions").alias("sessions"),
        F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue")))
    sets = [[F.col(c) for c in (*chosen, "_bucket")] for n in range(len(dims) + 1) for chosen in itertools.combinations(dims, n)]
    merged = finest.groupingSets(sets, *dims, "_bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("_users")).alias("active_users"), F.sum("sessions").alias("sessions"),
        F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"), *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    cube = merged.groupBy(*dims, *[f"_g_{d}" for d in dims]).agg(
        *[F.sum(c).alias(c) for c in ("sessions", "active_users", "orders", "revenue")])
    sel = []
    for d in dims:
        sel.append(F.when(F.col(f"_g_{d}") == 1, F.lit(ALL)).otherwise(F.col(d).cast("string")).alias(d))
    orders = F.col("orders")
    def shown(d):  # booleans print as True / False in the filter text
        v = F.col(d).cast("string")
        return F.initcap(v) if d == "loyalty_flag" else v
    text_parts = [F.when(F.col(f"_g_{d}") == 0,
                         F.concat(F.lit(d.replace("_", " ") + " = "), shown(d))) for d in dims]
    uplift = _overall_uplift(T, experiment)
    aov = F.coalesce(safe_div(F.col("revenue"), orders), F.lit(0.0))
    # The uplift frame is one row; the cube is at most 4*3*6*3*3 rows here.
    return cube.crossJoin(F.broadcast(uplift)).select(
        *sel,
        F.col("sessions"), F.col("active_users"), orders.alias("orders"),
        F.col("revenue"),
        F.when(F.col("sessions") == 0, F.lit(0.0)).otherwise(orders.cast("double") / F.col("sessions"))
         .alias("conversion_rate"),
        aov.alias("average_order_value"),
        F.col("experiment_uplift"),
        (F.col("experiment_uplift") * F.col("sessions") * aov).alias("commercial_impact_estimate"),
        F.concat(F.lit("Active filters: "),
                 F.coalesce(F.nullif(F.concat_ws(", ", *text_parts), F.lit("")), F.lit("All traffic")))
         .alias("filter_text"),
    )
