import math

from pyspark.sql import functions as F

from shopmetrics.functions.stats import erfc_nonneg, with_two_proportion_test


def test_erfc_matches_math(spark):
    xs = [i / 50 for i in range(0, 451)] + [0.46875, 4.0, 5.5, 26.9]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", erfc_nonneg(F.col("x")).alias("e")).collect()
    for r in got:
        ref = math.erfc(r.x)
        assert abs(r.e - ref) <= 1e-15 + 1e-13 * ref, (r.x, r.e, ref)


def _test(spark, cc, cn, vc, vn):
    df = spark.createDataFrame([(cc, cn, vc, vn)], "cc long, cn long, vc long, vn long")
    return with_two_proportion_test(df, "cc", "cn", "vc", "vn").collect()[0]


def test_z_test_against_formula(spark):
    r = _test(spark, 978, 1998, 964, 2008)
    cr, vr = 978 / 1998, 964 / 2008
    pooled = (978 + 964) / (1998 + 2008)
    se = math.sqrt(pooled * (1 - pooled) * (1 / 1998 + 1 / 2008))
    z = (vr - cr) / se
    assert abs(r.z_score - z) < 1e-12
    assert abs(r.p_value - math.erfc(abs(z) / math.sqrt(2))) < 1e-12
    assert abs(r.ci_low - (vr - cr - 1.96 * se)) < 1e-12
    assert r.is_significant is False


def test_degenerate_inputs(spark):
    r = _test(spark, 0, 10, 0, 10)  # SE = 0 -> z = 0, p = 1
    assert r.z_score == 0.0 and abs(r.p_value - 1.0) < 1e-15 and r.uplift_pct == 0.0
    r = _test(spark, 5, 10, None, None)  # missing variant -> NULL statistics
    assert r.variant_rate is None and r.p_value is None and r.is_significant is None
    r = _test(spark, 30, 10, 30, 10)  # more conversions than sessions -> NULL, no error
    assert r.z_score is None and r.ci_low is None
