from pyspark.sql import functions as F

from shopmetrics.operators.silver import clean_events, first_per_key, tolerant_bigint


def test_tolerant_bigint(spark):
    df = spark.createDataFrame([("12.0",), ("12.7",), ("",), ("x",), (None,), ("7",)], "v string")
    got = [r[0] for r in df.select(tolerant_bigint(F.col("v"))).collect()]
    assert got == [12, 13, None, None, None, 7]


def test_first_per_key_nulls_last_and_tiebreak(spark):
    rows = [(1, None, "b"), (1, "2024-01-02 00:00:00", "z"), (1, "2024-01-02 00:00:00", "a"),
            (2, None, "only-null")]
    df = spark.createDataFrame(rows, "k int, ts string, v string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.k: r.v for r in first_per_key(df, ["k"], "ts", tiebreak=["v"]).collect()}
    assert got == {1: "a", 2: "only-null"}


def test_clean_events_filters_before_dedup(spark):
    # The earliest copy has a NULL timestamp: it is filtered first, so the later copy survives.
    raw = spark.createDataFrame(
        [(1, 10, 5, None, "HOMEPAGE_VIEW", "3.0", "Mobile", "EU", "new", True, "APP"),
         (1, 10, 5, "2024-01-01 10:00:00", "error", "3.0", "Mobile", "EU", "new", True, "APP")],
        "event_id long, session_id long, user_id long, event_timestamp string, event_name string, product_id string,"
        " device_type string, region string, customer_type string, loyalty_flag boolean, channel string")
    out = clean_events(raw).collect()
    assert len(out) == 1 and out[0].event_name == "error" and out[0].product_id == 3
    assert out[0].device_type == "mobile" and out[0].channel == "app"


def test_dedup_plan_has_partial_group_limit(spark):
    import __spark_entry__ as E
    df = E.queries()["clean_events"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
