
from pyspark.sql import functions as F

from micro import event, order, tables, ts
from shopmetrics.operators import gold as G
from shopmetrics.operators import metrics as M

U = [(1, "EUROPE", "new", True, None), (2, "ASIA", "returning", False, None)]


def test_two_orders_in_one_session_convert_twice(spark):  # Q-2
    T = tables(spark, users=U, sessions=[(100, 1, ts("2024-01-01 10:00:00"), "mobile", "app")],
               orders=[order(1, 100, 1, "2024-01-01 10:05:00", 10.0), order(2, 100, 1, "2024-01-01 10:06:00", 0.0)],
               assignments=[(1, "exp", "control", ts("2024-01-01 00:00:00"))])
    r = G.gold_experiment_results(T).where("segment_type = 'overall'").collect()[0]
    assert (r.sessions, r.conversions, r.revenue) == (1, 2, 10.0)
    assert r.avg_order_value == 10.0  # zero-revenue order excluded from the mean (Q-4)
    assert r.conversion_rate == 2.0


def test_two_experiments_double_sums_not_sessions(spark):  # Q-3
    T = tables(spark, users=U, sessions=[(100, 1, ts("2024-01-01 10:00:00"), "mobile", "app")],
               orders=[order(1, 100, 1, "2024-01-01 10:05:00", 10.0)],
               assignments=[(1, "exp_a", "control", ts("2024-01-01 00:00:00")),
                            (1, "exp_b", "control", ts("2024-01-01 00:00:00"))])
    r = G.gold_experiment_results(T).where("segment_type = 'overall'").collect()[0]
    assert (r.sessions, r.conversions, r.revenue) == (1, 2, 20.0)
    r1 = M.experiment_results(T, experiment_name="exp_a").where("segment_type = 'overall'").collect()[0]
    assert (r1.sessions, r1.conversions, r1.revenue) == (1, 1, 10.0)


def test_midnight_order_and_order_only_days(spark):  # Q-7
    T = tables(spark, users=U,
               sessions=[(100, 1, ts("2024-01-01 23:55:00"), "mobile", "app")],
               orders=[order(1, 100, 1, "2024-01-02 00:05:00", 5.0)])
    rows = G.gold_daily_kpis(T).collect()
    # The order's day has no sessions, so it vanishes; the session day has 0 orders.
    assert [(str(r.event_date), r.sessions, r.orders) for r in rows] == [("2024-01-01", 1, 0)]


def test_session_without_user_counts_in_g1_not_m3(spark):
    T = tables(spark, users=U,
               sessions=[(100, 1, ts("2024-01-01 10:00:00"), "mobile", "app"),
                         (101, 99, ts("2024-01-01 11:00:00"), "desktop", "web")])
    assert G.gold_daily_kpis(T).collect()[0].sessions == 2
    m = M.executive_metrics(T).collect()[0]
    assert m.active_users == 1 and m.orders == 0 and m.conversion_rate == 0.0


def test_funnel_zero_previous_step_and_later_step_larger(spark):  # M4, Q-1
    s = [(100 + i, 1, ts("2024-01-01 10:00:00"), "mobile", "app") for i in range(3)]
    ev = [event(1, 100, 1, "2024-01-01 10:00:00", "homepage_view"),
          event(2, 100, 1, "2024-01-01 10:01:00", "product_view"),
          event(3, 101, 1, "2024-01-01 10:01:00", "product_view"),
          event(4, 102, 1, "2024-01-01 10:01:00", "product_view")]
    T = tables(spark, users=U, sessions=s, events=ev)
    g = {r.event_name: r for r in G.gold_funnel_metrics(T).collect()}
    assert g["search"].sessions == 0 and g["product_view"].sessions == 3
    assert g["product_view"].step_conversion_rate is None  # previous step is 0 -> NULL in G2
    assert g["search"].step_conversion_rate == 0.0 and g["search"].dropoff_rate == 1.0
    m = {r.event_name: r for r in M.funnel_metrics(T).collect()}
    assert m["product_view"].step_conversion_rate == 1.0 and m["product_view"].dropoff_rate == 0.0
    assert m["homepage_view"].step_conversion_rate == 1.0 and m["homepage_view"].dropoff_rate == 0.0
    assert m["product_view"].conversion_from_start == 3.0


def test_product_without_events(spark):
    T = tables(spark, products=[(7, "p7", "c", 10.0, 0.2), (8, "p8", "c", 20.0, 0.3)],
               events=[event(1, 100, 1, "2024-01-01 10:00:00", "product_view", 7),
                       event(2, 101, 1, "2024-01-01 10:00:00", "add_to_basket", 7),
                       event(3, 101, 1, "2024-01-01 10:01:00", "add_to_basket", 7)])
    got = {r.product_id: (r.product_view_sessions, r.add_to_basket_sessions, r.average_price)
           for r in G.gold_product_performance(T).collect()}
    assert got == {7: (2, 1, 10.0), 8: (0, 0, 20.0)}


def test_segment_sessions_add_up_and_cube_all_equals_m3(spark):
    import __spark_entry__ as E
    from shopmetrics.plans.layers import clean_tables
    T = clean_tables(spark, "/root/testdata/sf0.001")
    seg = M.segment_performance(T)
    totals = {r.segment_type: r.s for r in seg.groupBy("segment_type").agg(F.sum("sessions").alias("s")).collect()}
    m3 = M.executive_metrics(T).collect()[0]
    sessions = T["clean_sessions"].join(T["clean_users"], "user_id").select("session_id").distinct().count()
    assert set(totals.values()) == {sessions}
    cube_all = M.kpi_cube(T).where(" AND ".join(f"{d} = 'All'" for d in M.SIDEBAR_ORDER)).collect()[0]
    assert cube_all.orders == m3.orders and cube_all.active_users == m3.active_users
    assert abs(cube_all.revenue - m3.revenue) < 1e-6
    assert abs(cube_all.commercial_impact_estimate - m3.commercial_impact_estimate) < 1e-6
    assert cube_all.filter_text == "Active filters: All traffic"
    mobile = M.executive_metrics(T, {"device_type": "mobile"}).collect()[0]
    cube_mobile = M.kpi_cube(T).where("device_type = 'mobile' AND region = 'All' AND customer_type = 'All' "
                                      "AND loyalty_flag = 'All' AND channel = 'All'").collect()[0]
    assert cube_mobile.orders == mobile.orders
    assert cube_mobile.filter_text == "Active filters: device type = mobile"
    assert E.entry(spark).count() > 0


def test_filter_predicate_sentinels(spark):  # M1
    from shopmetrics.operators.base import active_filters, apply_filters
    assert active_filters({"device_type": "All", "region": None, "channel": "app", "bogus": "x"}) == {"channel": "app"}
    df = spark.createDataFrame([(True, "app"), (False, "app"), (True, "web")], "loyalty_flag boolean, channel string")
    assert apply_filters(df, {"loyalty_flag": "True", "channel": "app"}).count() == 1
    assert apply_filters(df, {"loyalty_flag": False}).count() == 1
    assert apply_filters(df, {"loyalty_flag": "All", "channel": "All"}).count() == 3
