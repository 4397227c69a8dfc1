"""Groups of sets that may be alike, cut into bounded tiles for comparison.

``tiled`` deals the members of each group to tiles so that any two members whose
sizes allow a link meet in exactly one of them, and none of them grows with the
group: a member gets a size band (sets whose sizes differ by more than the wanted
similarity allows are at least two bands apart) and, by a hash, one of the band's
row blocks; a tile is a pair of blocks of one band or of neighbouring bands.
Small groups are one tile as they are."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 512              # members of a block, about
VALUES = 400_000        # values of a block's sets, about
COLUMNS = 2048          # of a block of the incidence matrix


def band(n: str, percent: int) -> Column:
    """Of two sizes n1 <= n2 with 100 * n1 >= percent * n2 the bands are equal or
    neighbours (the base is a little wider, for rounding)."""
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(-math.log((percent - 0.1) / 100))).cast("int")


def tiled(members: DataFrame, group: str, percent: int) -> DataFrame:
    """``members`` (with n, the size, a hashable ``member`` and the group) with a
    column ``tile`` and their ``side`` in it; one row for each tile of a member.
    ``members`` is read twice and should be durable."""
    banded = members.withColumn("band", band("n", percent))
    sizes = banded.groupBy(group, "band").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("values"))

    def blocks(rows: Column, values: Column) -> Column:
        return F.greatest(F.ceil(rows / ROWS), F.ceil(values / VALUES), F.lit(1)).cast("int")
    whole = sizes.groupBy(group).agg((blocks(F.sum("rows"), F.sum("values")) == 1).alias("whole"))
    each = sizes.select(group, "band", blocks(F.col("rows"), F.col("values")).alias("blocks"))
    below = each.select(group, (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    above = each.select(group, (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    plan = (each.join(whole, group).join(below, [group, "band"], "left").join(above, [group, "band"], "left")
            .withColumns({"below": F.coalesce("below", F.lit(0)), "above": F.coalesce("above", F.lit(0))}))
    me = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    b = F.col("band")

    def with_each(n: Column, key) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), key)).otherwise(F.array().cast(_KEYS))

    def key(lo_band, lo, hi_band, hi, side) -> Column:
        return F.struct(lo_band.alias("lo_band"), lo.alias("lo"), hi_band.alias("hi_band"), hi.alias("hi"), side.cast("int").alias("side"))
    one = F.array(key(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    several = F.concat(
        with_each(F.col("blocks"), lambda j: key(b, F.least(me, j), b, F.greatest(me, j), me > j)),
        with_each(F.col("above"), lambda j: key(b, me, b + 1, j, F.lit(0))),
        with_each(F.col("below"), lambda j: key(b - 1, j, b, me, F.lit(1))))
    return (banded.join(plan, [group, "band"]).withColumn("to", F.explode(F.when(F.col("whole"), one).otherwise(several)))
            .withColumns({"tile": F.struct(group, "to.lo_band", "to.lo", "to.hi_band", "to.hi"), "side": F.col("to.side")})
            .drop("band", "blocks", "whole", "below", "above", "to", group))


_KEYS = "array<struct<lo_band:int,lo:int,hi_band:int,hi:int,side:int>>"


def _incidence(sets: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the values in ``known``, by column."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.empty(0, np.int64)
    at = np.searchsorted(known, values)
    hit = known[np.minimum(at, len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)
    row, at = row[hit], at[hit]
    order = np.argsort(at, kind="stable")
    return row[order], at[order]


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Boolean matrix of the pairs with 100 * intersection >= percent * union (no
    row with itself where ``b`` is None). The product of the two incidence matrices
    is added up by blocks of columns; a row or column whose pairs can no longer
    reach the overlap that their sizes ask for leaves the product."""
    own = b is None
    other = a if own else b
    na, nb = (np.array([len(s) for s in x], np.int64) for x in (a, other))
    out = np.zeros((len(a), len(other)), bool)
    if own:
        values, counts = np.unique(np.concatenate(a) if a else np.empty(0, np.int64), return_counts=True)
        shared, counts = values[counts > 1], counts[counts > 1]
    else:
        shared = np.intersect1d(np.concatenate(a), np.concatenate(other))
    if not len(shared):
        return out
    (ra, ca), (rb, cb) = _incidence(a, shared), _incidence(other, shared)
    rest_a, rest_b = np.bincount(ra, minlength=len(a)), np.bincount(rb, minlength=len(other))
    ia, ib = np.arange(len(a)), np.arange(len(other))
    overlap = np.zeros((len(a), len(other)), np.float32)  # counts below 2 ** 24 are exact

    def fits(x):  # overlap >= percent / (100 + percent) * (na + nb)
        return (100 + percent) * x.astype(np.int64) >= percent * (na[ia][:, None] + nb[ib][None, :])
    for lo in range(0, len(shared) + COLUMNS, COLUMNS):
        may = fits(overlap + np.minimum(rest_a[ia][:, None], rest_b[ib][None, :]))
        if own and lo == 0:
            np.fill_diagonal(may, False)
        rows, cols = may.any(1), may.any(0)
        if not rows.any():
            return out
        if rows.sum() < 0.7 * len(rows) or cols.sum() < 0.7 * len(cols):
            overlap, ia, ib = overlap[np.ix_(rows, cols)], ia[rows], ib[cols]
        if lo >= len(shared):
            break

        def block(r, c, index, n):
            part = slice(*np.searchsorted(c, [lo, lo + COLUMNS]))
            place = np.full(n, -1)
            place[index] = np.arange(len(index))
            dense = np.zeros((len(index), min(COLUMNS, len(shared) - lo)), np.float32)
            here = place[r[part]] >= 0
            dense[place[r[part]][here], c[part][here] - lo] = 1
            return dense, np.bincount(r[part], minlength=n)
        da, gone_a = block(ra, ca, ia, len(a))
        db, gone_b = block(rb, cb, ib, len(other))
        overlap += da @ db.T
        rest_a, rest_b = rest_a - gone_a, rest_b - gone_b
    found = fits(overlap) & (overlap > 0)
    out[np.ix_(ia, ib)] = found
    if own:
        np.fill_diagonal(out, False)
    return out


def roots(links: np.ndarray) -> np.ndarray:
    """The least row that each row of a symmetric matrix reaches."""
    label = np.arange(len(links))
    rows, cols = np.nonzero(links)
    while True:
        least = label.copy()
        np.minimum.at(least, rows, label[cols])
        least = least[least]
        if (least == label).all():
            return label
        label = least
