"""K1 stored tables: versions, one pointer, refresh, layout, changed sources."""

import os
import shutil
import uuid

import pytest

import __spark_entry__ as E
from shopmetrics.operators import metrics as M
from shopmetrics.operators import quality as D
from shopmetrics.operators import retrieval as R
from shopmetrics.plans.layers import clean_tables, rebuild_layers
from shopmetrics.plans.tables import DATE, Tables
from shopmetrics.session import shared_dir
from shopmetrics.sources import files

SF = "/root/testdata/sf0.001"


def own(spark, name="t"):
    tag = uuid.uuid4().hex[:8]
    return Tables(spark, shared_dir(spark, f"{name}-{tag}"), f"{name}_{tag}")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rebuilt(spark):
    tables = own(spark, "shop")
    assert len(rebuild_layers(spark, SF, tables)) == 17
    return tables


def test_tables_by_name(spark, rebuilt):
    lazy = clean_tables(spark, SF, materialized=False)
    for name in lazy.keys():
        stored = spark.sql(f"SELECT * FROM {rebuilt.database}.{name}")
        assert stored.columns == lazy[name].columns and stored.count() == lazy[name].count(), name
        assert rebuilt.measures(name)["rows"] == stored.count()
    assert spark.table(f"{rebuilt.database}.gold_funnel_metrics").count() == 6
    assert rebuilt["gold_product_performance"].count() == lazy["clean_products"].count()


def test_stored_measures_equal_a_fresh_scan(spark):
    T = clean_tables(spark, SF)
    for key, scan in (("dq_row_counts", D.row_counts(T)),
                      ("dq_missing_timestamps", D.missing_values(T["clean_events"], "event_timestamp", "missing_event_timestamps"))):
        got = {r.check: r.value for r in E.queries()[key](spark, SF).collect()}
        assert {r.check: r.value for r in scan.collect()}.items() <= got.items()
    assert "FileScan" not in plan_of(E.queries()["dq_row_counts"](spark, SF))


def test_a_run_killed_half_way_shows_the_old_tables(spark):
    tables = own(spark)
    tables.rebuild([("one", lambda _: {"a": spark.range(3), "b": spark.range(4)})])

    def fails(_):
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        tables.rebuild([("one", lambda _: {"a": spark.range(30)}), ("two", fails)])
    assert (tables["a"].count(), tables["b"].count()) == (3, 4)
    later = Tables(spark, tables.root, tables.database)  # a run after the one that failed
    assert set(later.refresh()) == {"a", "b"} and later["a"].count() == 3
    later.rebuild([("one", lambda _: {"a": spark.range(30)}), ("two", lambda seen: {"b": seen["a"].where("id < 7")})])
    assert (tables["a"].count(), tables["b"].count()) == (30, 7)


def test_old_versions_go(spark):
    tables = own(spark)
    for n in range(4):
        tables.rebuild([("one", lambda _, n=n: {"a": spark.range(n + 1)})])
    assert tables["a"].count() == 4 and len(files.names(spark, f"{tables.root}/a")) == 2  # the current one and that before


def test_refresh_in_a_session_that_knows_nothing(spark):
    tables = own(spark)
    events = spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 5 AS int)) AS event_timestamp FROM range(50)")
    orders = spark.sql("SELECT id AS order_id, id % 7 AS session_id FROM range(20)")
    tables.rebuild([("silver", lambda _: {"clean_events": events, "clean_orders": orders})])
    for t, entry in tables.current().items():
        spark.sql(f"DROP VIEW {tables.database}.{t}")
        spark.sql(f"DROP TABLE {tables.database}.{t}__{entry['version']}")
    Tables(spark, tables.root, tables.database).refresh()
    assert tables["clean_events"].count() == 50 and tables["clean_events"].columns == ["event_id", "event_timestamp"]
    assert "SelectedBucketsCount" in plan_of(tables["clean_orders"].groupBy("session_id").count())
    day = tables.on_dates("clean_events", "2024-01-02", "2024-01-02")
    assert day.count() == 10 and f"PartitionFilters: [isnotnull({DATE}" in plan_of(day)
    assert tables.measures("clean_events") == {"rows": 50, "missing_event_id": 0, "missing_event_timestamp": 0}


def test_session_join_needs_no_exchange(spark, rebuilt):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        T = {n: rebuilt[n] for n in ("clean_sessions", "clean_orders", "clean_users", "clean_experiment_assignments")}
        plan = plan_of(M.experiment_results(T))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning(user_id" in plan and "Exchange hashpartitioning(session_id" not in plan


def test_changed_sources_give_the_new_answer(spark, tmp_path):
    for t in os.listdir(SF):
        shutil.copy(f"{SF}/{t}", tmp_path / t)
    counts = E.queries()["dq_row_counts"]
    first = {r.check: r.value for r in counts(spark, str(tmp_path)).collect()}
    users = spark.read.parquet(f"{SF}/customer.parquet")
    users.where("c_custkey % 2 = 0").coalesce(1).write.parquet(f"{tmp_path}/half")
    part, = (n for n in os.listdir(tmp_path / "half") if n.startswith("part-"))
    shutil.copy(tmp_path / "half" / part, tmp_path / "customer.parquet")
    second = {r.check: r.value for r in counts(spark, str(tmp_path)).collect()}
    assert second["clean_users_rows"] == users.where("c_custkey % 2 = 0").count() < first["clean_users_rows"]


def test_load_documents_from_files(spark, tmp_path):
    for name, text in [("b_guide.md", "Checkout  guide\n\nmobile conversion"), ("a_intro.md", "Intro text")]:
        (tmp_path / name).write_text(text, encoding="utf-8")
    docs = R.load_documents(spark, str(tmp_path))
    rows = sorted((r.doc_id, r.source) for r in docs.collect())
    assert [s for _, s in rows] == ["a_intro.md", "b_guide.md"]  # document order = file name order
    q = spark.createDataFrame([(1, "mobile checkout")], "question_id long, question string")
    ctx = R.format_context(docs, R.top_documents(docs, q)).collect()[0].context
    assert ctx == "Source: b_guide.md\nCheckout guide mobile conversion"
    assert os.path.exists(tmp_path / "a_intro.md")
