"""Report tables N1-N5: deterministic text over computed metrics.

All text is built with Column expressions (``format_number``,
``format_string``, ``concat``) over small metric frames, one row per slice of
the KPI cube or per question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formatting import compact_currency, currency, fixed, percent, thousands
from ..functions.text import PY_WHITESPACE, _char_class

# The rule-based report texts.
RECOMMENDATION_TEXT = ("Prioritise checkout improvements for high-intent mobile users and scale the variant "
                       "for returning users if operational constraints allow.")
FALLBACK_NOTE = "Fallback mode used. Recommendation is based on calculated KPI, funnel, and experiment tables."
STRUCTURED_RECOMMENDATION = ("Continue the checkout friction reduction work, but prioritise mobile checkout "
                             "improvements before a full-scale rollout.")
VALIDATION_RATING = "supported with caveats"
VALIDATION_NOTE = ("Rule-based validation confirms the recommendation references calculated funnel and "
                   "experiment metrics.")
PRIORITY_TEXT = "Reduce mobile checkout friction"
PRIORITY_REASON = "Mobile has the largest traffic share and remains exposed to checkout drop-off."
KPI_CARDS = (
    ("Revenue", "Completed order revenue"),
    ("Orders", "Payment-complete orders"),
    ("Conversion", "Orders per session"),
    ("AOV", "Average order value"),
    ("Active Users", "Users with a session"),
    ("Experiment Uplift", "Relative variant lift"),
    ("Commercial Impact Estimate", "Estimated value from applying measured conversion uplift to selected traffic."),
    ("Control Conversion", "Baseline checkout rate"),
    ("Variant Conversion", "Reduced-friction checkout"),
    ("Relative Uplift", "Variant vs control"),
    ("p-value", "Statistical confidence"),
    ("Impact", "Estimated revenue lift"),
)
P_CUT = 0.05


# ---------------------------------------------------------------------- N1/N2
def insight_rows(metrics: DataFrame, summary: DataFrame) -> DataFrame:
    """N1 (fallback summary) and N2 (structured insight) for every row of
    ``metrics`` (M3 columns, e.g. one row per KPI-cube slice) against the
    one-row experiment ``summary`` (X2). N2's significance claim is gated on
    the p-value instead of always asserting significance."""
    sig = F.coalesce(F.col("p_value") < F.lit(P_CUT), F.lit(False))
    keep = [c for c in metrics.columns if c not in (
        "revenue", "orders", "conversion_rate", "average_order_value", "commercial_impact_estimate",
        "sessions", "active_users", "experiment_uplift")]
    s = summary.select("control_rate", "variant_rate", F.col("uplift").alias("exp_uplift"), "p_value")
    # ``summary`` is one row: the cross join only attaches its columns.
    j = metrics.crossJoin(F.broadcast(s))
    return j.select(
        *keep,
        F.concat(F.lit("Revenue is GBP "), thousands(F.col("revenue")), F.lit(" from "),
                 thousands(F.col("orders")), F.lit(" orders, with conversion at "),
                 fixed(F.col("conversion_rate") * 100, 2), F.lit("%. The experiment uplift is "),
                 fixed(F.col("exp_uplift") * 100, 2), F.lit(" percentage points.")).alias("insight"),
        F.concat(F.lit("AOV is GBP "), fixed(F.col("average_order_value"), 2),
                 F.lit("; estimated commercial impact is GBP "), thousands(F.col("commercial_impact_estimate")),
                 F.lit(". Experiment p-value is "), fixed(F.col("p_value"), 4), F.lit(".")).alias("evidence"),
        F.lit(RECOMMENDATION_TEXT).alias("recommendation"),
        F.when(sig, F.lit("high")).otherwise(F.lit("medium")).alias("confidence_level"),
        F.lit(FALLBACK_NOTE).alias("validation_notes"),
        F.concat(F.lit("The checkout experiment increased conversion from "), percent(F.col("control_rate")),
                 F.lit(" to "), percent(F.col("variant_rate")), F.lit(". The uplift is "),
                 F.when(sig, F.lit("statistically significant")).otherwise(F.lit("not statistically significant")),
                 F.lit(" with p-value "), fixed(F.col("p_value"), 4), F.lit(".")).alias("structured_insight"),
        F.concat(F.lit("The business generated GBP "), thousands(F.col("revenue")), F.lit(" from "),
                 thousands(F.col("orders")), F.lit(" orders. Overall conversion is "),
                 percent(F.col("conversion_rate")), F.lit(", AOV is GBP "), fixed(F.col("average_order_value"), 2),
                 F.lit(", and estimated commercial impact is GBP "), thousands(F.col("commercial_impact_estimate")),
                 F.lit(".")).alias("structured_evidence"),
    )


# ------------------------------------------------------------------------ N3
def report_bundle(insight: DataFrame, questions: DataFrame, contexts: DataFrame, quality: DataFrame,
                  drops: DataFrame, segments: DataFrame, lowest_k: int = 3) -> DataFrame:
    """One report per question -- the question, the insight texts (one row:
    filtered metrics, unfiltered experiment), the rule-based validation, the
    data-quality checks, the recommendation (mobile evidence and the lowest
    converting segments) and the question's retrieved context.

    ``quality`` (check, value), ``drops`` (event_name, dropoff_rate) and
    ``segments`` (M6 rows) are tiny marts; each folds into one row of JSON
    text, so every question joins a single broadcast row."""
    dq = quality.agg(F.to_json(F.array_sort(F.collect_list(F.struct("check", "value")))).alias("data_quality"))
    dr = drops.agg(F.to_json(F.array_sort(F.collect_list(F.struct("event_name", "dropoff_rate"))))
                   .alias("suspicious_funnel_drops"))
    seg_cols = ["segment_type", "segment_value", "sessions", "users", "orders", "conversion_rate", "revenue",
                "average_order_value"]
    mob = (segments.where((F.col("segment_type") == "device_type") & (F.col("segment_value") == "mobile"))
           .agg(F.to_json(F.array_sort(F.collect_list(F.struct(*seg_cols)))).alias("mobile_metrics")))
    w = Window.orderBy(F.col("conversion_rate").asc_nulls_last(), "segment_type", "segment_value")
    low = (segments.orderBy(F.col("conversion_rate").asc_nulls_last(), "segment_type", "segment_value")
           .limit(lowest_k).withColumn("rank", F.row_number().over(w))
           .agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", *seg_cols))),
                                      lambda r: r.dropFields("rank"))).alias("lowest_converting_segments")))
    one = insight.crossJoin(dq).crossJoin(dr).crossJoin(mob).crossJoin(low)  # 1 x 1 x 1 x 1 x 1
    return (questions.join(contexts, "question_id", "left")
            .crossJoin(F.broadcast(one))
            .select("question_id", "question", "filter_text", "insight", "evidence", "recommendation",
                    "confidence_level", F.col("validation_notes").alias("insight_notes"),
                    F.lit(VALIDATION_RATING).alias("support_rating"),
                    F.lit(VALIDATION_NOTE).alias("validation_notes"),
                    "data_quality", "suspicious_funnel_drops",
                    F.lit(PRIORITY_TEXT).alias("priority"), F.lit(PRIORITY_REASON).alias("reason"),
                    "mobile_metrics", "lowest_converting_segments",
                    F.coalesce(F.col("context"), F.lit("")).alias("retrieved_context")))


# ------------------------------------------------------------------------ N4
_WS = _char_class(PY_WHITESPACE)


def _strip_ws(col):
    return F.regexp_replace(col, f"^{_WS}+|{_WS}+$", "")


def _two_values(text):
    """The text as the first of two elements of a JSON array; the second, a hash of
    the text, must be found right behind it. (The parser stops after the first
    value, so the text alone would pass with anything behind a value.)"""
    return F.concat(F.lit("["), text, F.lit(',"'), F.sha2(text, 256), F.lit('"]'))


def _kept_json(text):
    """The JSON value that ``text`` is from end to end, as canonical text, else NULL.
    A text that cannot be one by its first character is not parsed."""
    value = F.try_parse_json(F.when(F.rlike(text, F.lit(r'^[\[{"tfn0-9-]')), _two_values(text)))
    ends_there = F.try_variant_get(value, "$[1]", "string") == F.sha2(text, 256)
    return F.when(F.coalesce(ends_there, F.lit(False)), F.to_json(F.try_variant_get(value, "$[0]", "variant")))


def parse_json_column(df: DataFrame, col: str = "response") -> DataFrame:
    """Tolerant JSON parse of a text column. Strip; drop a leading code
    fence (optional ``json`` tag, any case) and a trailing one; parse; else
    parse the outermost ``{...}``; else keep the text. Adds ``parsed``
    (canonical JSON text or NULL) and ``is_json``."""
    cleaned = _strip_ws(F.col(col))
    cleaned = _strip_ws(F.regexp_replace(cleaned, r"^```(?i:json)?", ""))
    cleaned = _strip_ws(F.regexp_replace(cleaned, r"```$", ""))
    # Of keys that repeat the last value holds, as in Python's json.
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    names = [f"_json_{i}" for i in range(4)]
    while set(names) & set(df.columns):
        names = [f"_{n}" for n in names]
    text, whole, inner_text, inner = names
    # In steps of their own, so that each text is cleaned and parsed once; the inner
    # text is looked for only where the whole one is no JSON.
    found = df.withColumn(text, cleaned)
    found = found.withColumn(whole, _kept_json(F.col(text)))
    found = found.withColumn(inner_text, F.when(F.col(whole).isNull(), F.nullif(F.regexp_extract(F.col(text), r"(?s)\{.*\}", 0), F.lit(""))))
    found = found.withColumn(inner, F.when(F.col(inner_text) != F.col(text), _kept_json(F.col(inner_text))))
    parsed = F.coalesce(F.col(whole), F.col(inner))
    return found.withColumn("parsed", parsed).withColumn("is_json", parsed.isNotNull()).drop(*names)


def responses_from_events(events: DataFrame) -> DataFrame:
    """Fixture for N4: model-style responses built from every event's props
    JSON -- fenced, wrapped in or behind prose, broken, doubled, bare, or no JSON
    at all (by event id)."""
    p = F.col("props")
    shape = F.col("event_id") % 8
    text = (F.when(shape == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
             .when(shape == 1, F.concat(F.lit("Here is the summary: "), p, F.lit(" -- end of answer.")))
             .when(shape == 2, F.regexp_replace(p, r"\}$", ""))
             .when(shape == 4, F.concat(F.lit("3 segments are weak: "), p))
             .when(shape == 5, F.concat(p, F.lit(" and "), p))
             .when(shape == 6, F.lit("true story"))
             .when(shape == 7, F.lit("[1,2] trailing"))
             .otherwise(p))
    return events.select("event_id", text.alias("response"))


# ------------------------------------------------------------------------ N5
def kpi_cards(metrics: DataFrame, summary: DataFrame) -> DataFrame:
    """One card per KPI of one metrics row (M3) and the experiment summary:
    (position, label, value, text, helper)."""
    s = summary.select("uplift_pct", "control_rate", "variant_rate", "p_value",
                       F.col("commercial_impact_estimate").alias("exp_impact"))
    j = metrics.crossJoin(F.broadcast(s))  # one row x one row
    cards = [
        (F.col("revenue"), compact_currency(F.col("revenue"))),
        (F.col("orders").cast("double"), thousands(F.col("orders"))),
        (F.col("conversion_rate"), percent(F.col("conversion_rate"))),
        (F.col("average_order_value"), currency(F.col("average_order_value"))),
        (F.col("active_users").cast("double"), thousands(F.col("active_users"))),
        (F.col("uplift_pct"), percent(F.col("uplift_pct"))),
        (F.col("commercial_impact_estimate"), currency(F.col("commercial_impact_estimate"))),
        (F.col("control_rate"), percent(F.col("control_rate"))),
        (F.col("variant_rate"), percent(F.col("variant_rate"))),
        (F.col("uplift_pct"), percent(F.col("uplift_pct"))),
        (F.col("p_value"), fixed(F.col("p_value"), 4)),
        (F.col("exp_impact"), currency(F.col("exp_impact"))),
    ]
    structs = [F.struct(F.lit(i + 1).alias("position"), F.lit(label).alias("label"),
                        value.cast("double").alias("value"), text.alias("text"), F.lit(helper).alias("helper"))
               for i, ((label, helper), (value, text)) in enumerate(zip(KPI_CARDS, cards))]
    return j.select(F.explode(F.array(*structs)).alias("c")).select("c.*")

