"""Statistics as Column expressions (no Python UDF): the normal tail via a
rational erfc, and the two-proportion z-test of an A/B readout (X1)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# W. J. Cody, "Rational Chebyshev approximations for the error
# function", Math. Comp. 23 (1969). Coefficients, highest power first.
ERFC_A = (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2,
          3.77485237685302021e2, 3.20937758913846947e3)
ERFC_B = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3,
          2.84423683343917062e3)
ERFC_C = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594,
          6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
          1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
ERFC_D = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
          1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
          3.43936767414372164e3, 1.23033935480374942e3)
ERFC_P = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
          1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
ERFC_Q = (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1,
          6.05183413124413191e-2, 2.33520497626869185e-3)
Z_95 = 1.96
ALPHA = 0.05


def _horner(coeffs, x: Column) -> Column:
    acc = F.lit(coeffs[0])
    for c in coeffs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def erfc_nonneg(x: Column) -> Column:
    """erfc(x) for x >= 0 as a Column (max relative error ~1e-15)."""
    x2 = x * x
    small = F.lit(1.0) - x * _horner(ERFC_A, x2) / _horner(ERFC_B, x2)
    mid = F.exp(-x2) * _horner(ERFC_C, x) / _horner(ERFC_D, x)
    inv = F.lit(1.0) / x2
    large = (F.exp(-x2) / x) * (F.lit(1.0 / math.sqrt(math.pi)) - inv * _horner(ERFC_P, inv) / _horner(ERFC_Q, inv))
    return (F.when(x.isNull(), F.lit(None).cast("double"))
             .when(x <= F.lit(0.46875), small)
             .when(x <= F.lit(4.0), mid)
             .when(x < F.lit(27.0), large)
             .otherwise(F.lit(0.0)))


def with_two_proportion_test(df: DataFrame, cc: str, cn: str, vc: str, vn: str) -> DataFrame:
    """Append the two-proportion z-test columns to ``df`` given the names
    of the control/variant conversion and size columns.

    Columns: control_rate, variant_rate, uplift, uplift_pct, z_score, p_value,
    ci_low, ci_high, is_significant. Degenerate inputs give NULL instead of
    raising: a missing variant (NULL sizes), zero sizes, or a pooled rate above
    1 (more orders than sessions). Each stage is its own projection so the
    erfc polynomial is generated once per row (a single nested expression
    exceeds the 64 KB method limit of whole-stage codegen)."""
    zero = F.lit(0.0)
    d = lambda c: F.col(c).cast("double")
    out = df.withColumns({
        "control_rate": d(cc) / F.nullif(d(cn), zero),
        "variant_rate": d(vc) / F.nullif(d(vn), zero),
        "_pooled": (d(cc) + d(vc)) / F.nullif(d(cn) + d(vn), zero),
    })
    out = out.withColumns({
        "uplift": F.col("variant_rate") - F.col("control_rate"),
        "_var": F.col("_pooled") * (F.lit(1.0) - F.col("_pooled"))
                * (F.lit(1.0) / F.nullif(d(cn), zero) + F.lit(1.0) / F.nullif(d(vn), zero)),
    })
    out = out.withColumn("_se", F.when(F.col("_var") >= zero, F.sqrt("_var")))
    out = out.withColumns({
        "uplift_pct": F.when(F.col("control_rate").isNull(), F.lit(None).cast("double"))
                       .when(F.col("control_rate") == zero, zero)
                       .otherwise(F.col("uplift") / F.col("control_rate")),
        "z_score": F.when(F.col("_se").isNull(), F.lit(None).cast("double"))
                    .when(F.col("_se") == zero, zero).otherwise(F.col("uplift") / F.col("_se")),
        "ci_low": F.col("uplift") - F.lit(Z_95) * F.col("_se"),
        "ci_high": F.col("uplift") + F.lit(Z_95) * F.col("_se"),
    })
    out = out.withColumn("_x", F.abs(F.col("z_score")) / F.lit(math.sqrt(2.0)))
    out = out.withColumn("p_value", erfc_nonneg(F.col("_x")))
    out = out.withColumn("is_significant", F.col("p_value") < F.lit(ALPHA))
    return out.drop("_pooled", "_var", "_se", "_x")


STAT_COLUMNS = ("control_rate", "variant_rate", "uplift", "uplift_pct", "z_score", "p_value",
                "ci_low", "ci_high", "is_significant")
