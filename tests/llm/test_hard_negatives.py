"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopmetrics.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, q string, anchor string"


def brute(rows, relabel=True):
    live = []
    for uid, (vec, x, label) in enumerate(rows):
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        if relabel and vec is not None and vec % 7 == 0:
            label = (label + 1) % 10
        live.append((uid, vec, label, [math.floor(256 * float(np.float32(v))) for v in x]))
    out = []
    for uid, vec, label, q in live:
        if vec is None or vec % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, r)), v is None, v or 0, u, lab) for u, v, lab, r in live if u != uid)
        for s, null, p, _, _ in [x for x in scored if x[4] == label][:5]:
            fits = [x for x in scored if x[4] != label and -80 * s <= -100 * x[0] <= -100 * s][:5]
            out += [(vec, None if null else p, i + 1, None if x[1] else x[2], -s, -x[0]) for i, x in enumerate(fits)]
    return sorted(out, key=str)


def mined(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = h.op13_hard_negatives(spark, str(tmp_path))
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()), key=str)


def test_tables_and_planes_give_inner_products():
    rnd = np.random.default_rng(1)
    for dims, top in ((8, 1), (24, 200), (64, 1 << 23)):
        a, c = rnd.integers(-top, top, (5, dims)), rnd.integers(-top, top, (40, dims))
        got = h.lookup_scores(h.subset_sums(a), h.bit_planes(c, int(top).bit_length() + 1))
        assert (got == c @ a.T).all()


@pytest.mark.parametrize("dims", [3, 8, 20])
def test_against_brute_force(spark, tmp_path, dims):
    rnd = random.Random(dims)
    rows = [(i, [rnd.choice([0.0, 0.25, -0.5, rnd.gauss(0, 0.4)]) for _ in range(dims)], rnd.randrange(10)) for i in range(700)]
    assert mined(spark, tmp_path, rows) == brute(rows)


def test_odd_rows(spark, tmp_path):
    one = [0.5, 0.5, 0.5]
    rows = [(0, one, 1), (100, one, 1), (100, one, 1), (None, one, 1), (None, [0.4, 0.5, 0.5], 2), (3, one, None), (4, None, 1),
            (5, [0.1, None, 0.2], 1), (6, [float("nan"), 1.0, 1.0], 2), (8, [float("inf"), 1.0, 1.0], 2), (9, [], 2), (11, [0.45], 2),
            (200, [-0.5, 0.1, 9.0], 3), (300, [0.0, 0.0, 0.0], 5), (301, [1.0, 1.0, 1.0], 5), (400, [], 6), (401, one + [7.0], 6)]
    rows += [(1000 + i, one, 2) for i in range(20)]                   # ties
    rows += [(2000 + 7 * i, [0.5, 0.5, 0.45], 1) for i in range(9)]   # labels that change
    assert mined(spark, tmp_path, rows) == brute(rows)
    huge = h.hard_negatives(spark.createDataFrame([(0, [1.0], 1), (1, [40000.0], 1), (2, [30000.0], 1), (3, [29000.0], 2)],
                                                  "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0).collect()
    assert [(r.positive_id, r.negative_id) for r in huge] == [(2, 3)]


def test_common_vector_and_empty_table(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, [0.25] * 8 if i % 3 else [rnd.gauss(0, 1) for _ in range(8)], 1 + (i % 2)) for i in range(900)]
    assert mined(spark, tmp_path / "a", rows) == brute(rows)
    assert mined(spark, tmp_path / "b", []) == []
