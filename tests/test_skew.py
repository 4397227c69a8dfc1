"""One key holding a third of all rows: results stay exact and whole."""

from pyspark.sql import functions as F

from micro import order, tables, ts
from shopmetrics.operators import gold as G
from shopmetrics.operators import metrics as M
from shopmetrics.operators.silver import clean_events


def test_hot_user_and_hot_event_id(spark):
    users = [(u, "EUROPE" if u % 2 else "ASIA", "new", u % 3 == 0, None) for u in range(1, 31)]
    # user 1 owns 30 of the 90 sessions
    sessions = [(1000 + i, 1 if i < 30 else 2 + i % 29, ts(f"2024-01-{1 + i % 28:02d} 10:00:00"),
                 "mobile" if i % 3 == 0 else "desktop", "app" if i % 2 else "web") for i in range(90)]
    orders = [order(5000 + i, 1000 + i, 0, f"2024-01-{1 + i % 28:02d} 11:00:00", float(i % 7), "control")
              for i in range(0, 90, 2)]
    assignments = [(u, "exp", "variant" if u % 2 else "control", ts("2024-01-01 00:00:00")) for u in range(1, 31)]
    T = tables(spark, users=users, sessions=sessions, orders=orders, assignments=assignments)
    overall = G.experiment_aggregate(G.experiment_base(T), [("overall", None)]).collect()
    assert sum(r.sessions for r in overall) == 90 and sum(r.conversions for r in overall) == 45
    assert abs(sum(r.revenue for r in overall) - sum(float(i % 7) for i in range(0, 90, 2))) < 1e-9
    # The hot user meets users and assignments as sums per (device, channel).
    assert G.experiment_base(T).where("user_id = 1").count() == 4
    cube_all = M.kpi_cube(T).where(" AND ".join(f"{d} = 'All'" for d in M.SIDEBAR_ORDER)).collect()[0]
    assert (cube_all.sessions, cube_all.active_users, cube_all.orders) == (90, 30, 45)
    seg = {(r.segment_type, r.segment_value): r.sessions for r in G.gold_segment_performance(T).collect()}
    assert seg[("device_type", "mobile")] + seg[("device_type", "desktop")] == 90

    # event id 7 is a third of all raw events: one row survives, the earliest.
    raw = spark.createDataFrame(
        [(7 if i % 3 == 0 else 100 + i, 1, 1, f"2024-01-01 10:{i % 60:02d}:00", "homepage_view", None,
          "mobile", "EU", "new", True, "app") for i in range(90)],
        "event_id long, session_id long, user_id long, event_timestamp string, event_name string,"
        " product_id string, device_type string, region string, customer_type string, loyalty_flag boolean,"
        " channel string")
    out = clean_events(raw)
    assert out.count() == 61
    assert out.where("event_id = 7").select(F.minute("event_timestamp")).collect()[0][0] == 0
