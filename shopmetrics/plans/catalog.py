"""The query catalogue: one callable ``(spark, sf_dir) -> DataFrame`` per
operator, each reading the driver's tables through the fixture adapter.

Outputs are rounded (every DOUBLE to 6 places) only here, at the comparison
boundary; the operators themselves return full precision.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators import experiment as X
from ..operators import gold as G
from ..operators import metrics as M
from ..operators import quality as D
from ..operators import reports as N
from ..operators import retrieval as RT
from ..functions.digest import column_digests, round6
from ..operators.base import filtered_session_users
from ..operators.silver import CLEANERS
from ..session import shared_dir
from ..sources.csv_io import DIALECT, RAW_SCHEMAS, export_marts, ingest_csv, read_csv_like, read_raw, write_csv
from ..sources.fixtures import raw_entities, read_table, source_state, write_documents
from .layers import clean_tables, gold_layer, rebuild_layers, shop_tables, stored_measures

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[round6(F.col(f.name)).alias(f.name) if isinstance(f.dataType, DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def _silver(name: str) -> Query:
    src, fn = CLEANERS[name]

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fn(raw_entities(spark, sf_dir)[src]))
    return q


def _on_clean(fn: Callable[[dict], DataFrame]) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fn(clean_tables(spark, sf_dir)))
    q.__doc__ = fn.__doc__
    return q


def _insight_rows(T, g3):
    return N.insight_rows(M.kpi_cube(T, experiment=g3), X.experiment_summary(T))


def _kpi_cards(T, g3):
    return N.kpi_cards(M.executive_metrics(T, experiment=g3), X.experiment_summary(T))


def _report_bundle(spark: SparkSession, sf_dir: str, filters: dict | None = None) -> DataFrame:
    """Metrics under ``filters`` beside the experiment, quality checks and
    segments over all traffic, as the shop's report has them."""
    T_ = clean_tables(spark, sf_dir)
    docs = RT.documents_table(read_table(spark, sf_dir, "documents"))
    questions = RT.questions_from_conversations(read_table(spark, sf_dir, "conversations"))
    g3 = gold_layer(spark, sf_dir)["gold_experiment_results"]
    metrics = M.executive_metrics(T_, filters, experiment=g3).withColumn("filter_text", F.lit(M.filter_text(filters)))
    insight = N.insight_rows(metrics, X.experiment_summary(T_)).select(
        "filter_text", "insight", "evidence", "recommendation", "confidence_level", "validation_notes")
    contexts = RT.format_context(docs, RT.top_documents(docs, questions))
    quality = D.data_quality(T_)
    drops = rounded(D.suspicious_drops(T_))
    segments = rounded(M.segment_performance(T_))
    return N.report_bundle(insight, questions, contexts, quality, drops, segments)


def _own_dir(spark: SparkSession, tag: str) -> str:
    return shared_dir(spark, f"{tag}-{uuid.uuid4().hex[:12]}")


def _all_digests(frames) -> DataFrame:
    """A row for each column of each (name, DataFrame): rows, values, digest."""
    return functools.reduce(DataFrame.unionByName, [column_digests(df, name) for name, df in frames])


def _as_csv(spark: SparkSession, sf_dir: str) -> str:
    """Stand-in input of B1: the six raw entities as headered CSV folders, events
    also with rows of two fields and rows with a time that is none."""
    root = _own_dir(spark, "bronze")
    raw = raw_entities(spark, sf_dir)
    for entity in RAW_SCHEMAS:
        write_csv(raw[entity], f"{root}/{entity}.csv")
    events = raw["raw_events"]
    short = events.where("event_id % 101 = 0").select("event_id", "session_id")
    odd = events.where("event_id % 103 = 0").withColumn("event_timestamp", F.lit("yesterday"))
    for extra in (short, odd):
        extra.write.mode("append").options(**DIALECT).csv(f"{root}/raw_events.csv")
    return root


def _bronze_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: all six entities read from CSV with their raw schemas; rows, values and
    a digest for each of their columns."""
    root = _as_csv(spark, sf_dir)
    return _all_digests((entity, ingest_csv(spark, root, entity)) for entity in RAW_SCHEMAS)


def _bronze_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: rows that were read and rows that were rejected, by entity and reason."""
    root = _as_csv(spark, sf_dir)
    parts = []
    for entity in RAW_SCHEMAS:
        good, rejects = read_raw(spark, root, entity)
        parts.append(good.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(entity).alias("entity"), F.lit("read").alias("outcome"), "rows"))
        parts.append(rejects.groupBy("entity", F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("rows")))
    return functools.reduce(DataFrame.unionByName, parts)


def _export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the four exported marts as CSV files, read back with their schemas; rows,
    values and a digest for each of their columns."""
    gold = G.gold_tables(clean_tables(spark, sf_dir))
    paths = export_marts(gold, _own_dir(spark, "gold-export"))
    return _all_digests((mart, read_csv_like(spark, path, gold[mart])) for mart, path in paths.items())


def _layer_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: bronze -> silver -> gold, all tables replaced and then read by their
    names; rows, values and a digest for each of their columns."""
    tables = shop_tables(spark, sf_dir, "rebuilt")
    return _all_digests((name, tables[name]) for name in sorted(rebuild_layers(spark, sf_dir, tables)))


def _load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table as ``.md`` files, loaded in name order."""
    return RT.load_documents(spark, write_documents(read_table(spark, sf_dir, "documents"), _own_dir(spark, "documents")))


def _tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.parse_json_column(N.responses_from_events(read_table(spark, sf_dir, "events")))


def _docs_questions(fn) -> Query:
    """Retrieval queries: the whole ``documents`` table against every user
    turn of ``conversations`` as a question."""
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = RT.documents_table(read_table(spark, sf_dir, "documents"))
        questions = RT.questions_from_conversations(read_table(spark, sf_dir, "conversations"))
        return rounded(fn(docs, questions))
    return q


def _with_gold(fn) -> Query:
    """Queries that, like the shop's metric queries, read the persisted Gold
    experiment mart (for the unfiltered uplift) next to the clean tables."""
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        T_ = clean_tables(spark, sf_dir)
        g3 = gold_layer(spark, sf_dir)["gold_experiment_results"]
        return rounded(fn(T_, g3))
    q.__doc__ = fn.__doc__
    return q


def _raw_and_clean(fn) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fn(clean_tables(spark, sf_dir), raw_entities(spark, sf_dir)))
    return q


def _row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 from what was counted while the clean tables were written."""
    return D.observed(spark, {f"{t}_rows": stored_measures(spark, sf_dir, t)["rows"] for t in D.ROW_COUNT_TABLES})


def _missing_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: of the clean events as counted while they were written, of the raw ones by a scan."""
    clean = stored_measures(spark, sf_dir, "clean_events")["missing_event_timestamp"]
    return D.observed(spark, {"missing_event_timestamps": clean}).unionByName(
        D.missing_values(raw_entities(spark, sf_dir)["raw_events"], "event_timestamp", "raw_missing_event_timestamps"))


# Fixed dashboard selections used by the filtered variants.
MOBILE = {"device_type": "mobile"}
MULTI_FILTER = {"device_type": "mobile", "region": "All", "customer_type": "returning", "channel": "app"}
SLICE_FILTER = {"region": "EUROPE", "loyalty_flag": True, "device_type": None}


def _fresh(fn: Query) -> Query:
    """The query, after a look whether the source files have changed."""
    @functools.wraps(fn)
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        source_state(spark, sf_dir)
        return fn(spark, sf_dir)
    return q


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["clean_users"] = _silver("clean_users")
    q["clean_products"] = _silver("clean_products")
    q["clean_sessions"] = _silver("clean_sessions")
    q["clean_events"] = _silver("clean_events")
    q["clean_orders"] = _silver("clean_orders")
    q["clean_assignments"] = _silver("clean_experiment_assignments")
    q["gold_daily_kpis"] = _on_clean(G.gold_daily_kpis)
    q["gold_funnel_metrics"] = _on_clean(G.gold_funnel_metrics)
    q["gold_experiment_results"] = _on_clean(G.gold_experiment_results)
    q["gold_segment_performance"] = _on_clean(G.gold_segment_performance)
    q["gold_product_performance"] = _on_clean(G.gold_product_performance)
    # M1-M9
    q["filtered_sessions"] = _on_clean(lambda T: filtered_session_users(T, SLICE_FILTER))
    q["filter_options"] = _on_clean(M.filter_options)
    q["executive_metrics"] = _with_gold(lambda T, g3: M.executive_metrics(T, experiment=g3))
    q["executive_metrics_mobile"] = _with_gold(lambda T, g3: M.executive_metrics(T, MOBILE, experiment=g3))
    q["funnel_metrics"] = _on_clean(M.funnel_metrics)
    q["funnel_metrics_mobile"] = _on_clean(lambda T: M.funnel_metrics(T, MOBILE))
    q["experiment_results"] = _on_clean(M.experiment_results)
    q["experiment_results_filtered"] = _on_clean(lambda T: M.experiment_results(T, MULTI_FILTER))
    q["segment_performance"] = _on_clean(M.segment_performance)
    q["segment_performance_filtered"] = _on_clean(lambda T: M.segment_performance(T, MULTI_FILTER))
    q["daily_kpis_filtered"] = _on_clean(lambda T: M.daily_kpis(T, MULTI_FILTER))
    q["metric_context"] = _with_gold(lambda T, g3: M.metric_context(T, prepare=rounded, experiment=g3))
    q["kpi_cube"] = _with_gold(lambda T, g3: M.kpi_cube(T, experiment=g3))
    # X1-X4
    q["ab_test_segments"] = _on_clean(X.experiment_readout)
    q["experiment_summary"] = _on_clean(X.experiment_summary)
    q["experiment_summary_filtered"] = _on_clean(lambda T: X.experiment_summary(T, SLICE_FILTER))
    q["ab_test_statement"] = _on_clean(lambda T: X.significance_statement(X.experiment_readout(T)))
    # D1-D4, R1-R2
    q["dq_row_counts"] = _row_counts
    q["dq_duplicate_events"] = _raw_and_clean(lambda T, R: D.duplicate_ids(T["clean_events"], "event_id", "duplicate_events")
                                              .unionByName(D.duplicate_ids(R["raw_events"], "event_id", "raw_duplicate_events")))
    q["dq_missing_timestamps"] = _missing_timestamps
    q["dq_suspicious_drops"] = _on_clean(D.suspicious_drops)
    q["mobile_segment"] = _on_clean(lambda T: D.segment_slice(M.segment_performance(T)))
    q["lowest_segments"] = _on_clean(lambda T: D.lowest_segments(G.gold_segment_performance(T)))
    # N1-N5 (N6/N7 are columns of M4-M7 and of the cube)
    q["insight_rows"] = _with_gold(_insight_rows)
    q["kpi_cards"] = _with_gold(_kpi_cards)
    q["tolerant_json"] = _tolerant_json
    q["report_bundle"] = _report_bundle
    q["report_bundle_filtered"] = lambda spark, sf_dir: _report_bundle(spark, sf_dir, MULTI_FILTER)
    # B1, K2
    q["bronze_roundtrip"] = _bronze_roundtrip
    q["bronze_row_counts"] = _bronze_counts
    q["export_roundtrip"] = _export_roundtrip
    q["layer_materialise"] = _layer_materialise
    # T1-T5
    q["load_documents"] = _load_documents
    q["query_terms"] = _docs_questions(lambda d, qs: RT.query_terms(qs))
    q["keyword_scores"] = _docs_questions(RT.keyword_scores)
    q["topk_documents"] = _docs_questions(RT.top_documents)
    q["context_snippets"] = _docs_questions(lambda d, qs: RT.format_context(d, RT.top_documents(d, qs)))
    return {k: _fresh(fn) for k, fn in q.items()}
