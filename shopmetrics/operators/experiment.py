"""Experiment statistics X2-X4 over the experiment results (M5)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import percent
from ..functions.stats import STAT_COLUMNS, with_two_proportion_test
from . import gold as G
from .metrics import experiment_results


def _pivot_variants(results: DataFrame, keys) -> DataFrame:
    """One row per ``keys`` with control/variant sessions, conversions and
    AOV side by side (conditional max = pivot on a known two-value domain)."""
    def pick(variant, col):
        return F.max(F.when(F.col("variant") == variant, F.col(col))).alias(f"{variant}_{col}")
    return results.groupBy(*keys).agg(
        pick("control", "sessions"), pick("control", "conversions"),
        pick("variant", "sessions"), pick("variant", "conversions"),
        pick("control", "avg_order_value"), pick("variant", "avg_order_value"))


def _with_test(p: DataFrame, keys) -> DataFrame:
    t = with_two_proportion_test(p, "control_conversions", "control_sessions",
                                 "variant_conversions", "variant_sessions")
    impact = (F.col("uplift") * F.col("variant_sessions").cast("double")
              * F.col("variant_avg_order_value"))
    return t.select(*keys, "control_sessions", "control_conversions", "variant_sessions",
                    "variant_conversions", *STAT_COLUMNS, impact.alias("commercial_impact_estimate"))


def ab_test_readout(results: DataFrame) -> DataFrame:
    """The two-proportion test for every (segment_type, segment_value)
    of the experiment results at once."""
    keys = ["segment_type", "segment_value"]
    return _with_test(_pivot_variants(results, keys), keys)


def experiment_summary(T: Mapping[str, DataFrame], filters: Mapping | None = None,
                       experiment_name: str | None = None) -> DataFrame:
    """The overall/all rows of M5 under ``filters``, pivoted by variant,
    the z-test, and impact = uplift x variant sessions x variant AOV.
    A missing variant yields NULL statistics instead of an error."""
    base = G.experiment_base(T, filters, experiment_name)
    overall = G.experiment_aggregate(base, [("overall", None)])
    return _with_test(_pivot_variants(overall, ["segment_type", "segment_value"]),
                      ["segment_type", "segment_value"]).drop("segment_type", "segment_value")


def experiment_readout(T: Mapping[str, DataFrame], filters: Mapping | None = None,
                       experiment_name: str | None = None) -> DataFrame:
    """X3 over M5 (all six segmentations)."""
    return ab_test_readout(experiment_results(T, filters, experiment_name))


def significance_statement(readout: DataFrame) -> DataFrame:
    """The dashboard's verdict text and confidence level per row."""
    sig = F.coalesce(F.col("is_significant"), F.lit(False))
    pct = lambda c: percent(F.col(c))
    text = F.concat(
        F.lit("The 95% confidence interval for absolute uplift is "), pct("ci_low"), F.lit(" to "),
        pct("ci_high"), F.lit(". The result is "),
        F.when(sig, F.lit("statistically significant")).otherwise(F.lit("not statistically significant")),
        F.lit(" at p < 0.05."))
    return readout.select(
        *[c for c in readout.columns if c in ("segment_type", "segment_value")],
        "p_value", "is_significant",
        F.when(sig, F.lit("high")).otherwise(F.lit("medium")).alias("confidence_level"),
        text.alias("statement"))
