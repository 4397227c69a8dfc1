"""Hard-negative mining with Four-Russians scoring.

Vectors are quantised to integers (``floor(256 * x)``), so scores are exact
integer inner products. A candidate's integers are cut into bit planes (two's
complement); eight dimensions of a plane are one byte. For each anchor and each
group of eight dimensions a table holds the sums of all 256 subsets of the
anchor's eight integers. A candidate's score is then a sum of table lookups, one
for each plane and group, shifted by the plane (the sign plane subtracts).

Plan. Rows are quantised once and written; candidates are packed into blocks of
planes and anchors into blocks of their integers, and every anchor block meets
every candidate block (the search is that of a stated query set against all
rows). A task keeps the best few rows of each anchor it has and only emits those,
a window merges them. There are two such searches: one for the positives, one for
the negatives, which need the positives' scores. Anchor blocks are broadcast only
where Spark's own size limit for that holds; else blocks meet in a Cartesian
product of partitions. No score is kept that is not among an anchor's best.

Defined results
- a null label, a null vector, or a null, non-finite or too large component
  (2 ** 15 or more, beyond which sums could leave 64 bits): the row takes no part;
- vectors of different lengths are compared as if zeros followed the shorter one
  (an empty vector has score 0 with all);
- rows that repeat a vec_id are rows of their own: each anchors, and the others
  are its possible partners; a null vec_id cannot anchor, but can be found (null
  positive_id or negative_id) and is last among equal scores;
- an anchor without another row of its label, or a positive without a negative in
  its range (so each with a negative score), has no rows;
- extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, forget, ship, table

SCALE = 256
TOO_LARGE = float(1 << 15)
GROUP = 8               # dimensions of one table, bits of one byte
ANCHOR_BLOCK = 256
CANDIDATE_BLOCK = 2048
POSITIVES, NEGATIVES = 5, 5
LEAST_PERCENT, MOST_PERCENT = 80, 100


# ------------------------------------------------------------------- the method
def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each group of eight dimensions the sums over
    every subset of an anchor's integers, by doubling."""
    n, dims = anchors.shape
    out = np.zeros((dims // GROUP, 1 << GROUP, n), anchors.dtype)
    for g in range(dims // GROUP):
        for d in range(GROUP):
            out[g, 1 << d:2 << d] = out[g, :1 << d] + anchors[:, g * GROUP + d]
    return out


def bit_planes(q: np.ndarray, planes: int) -> np.ndarray:
    """(planes, groups, rows) bytes: bit d of a byte is that of its d-th dimension."""
    bits = (q[None] >> np.arange(planes, dtype=q.dtype)[:, None, None]) & 1
    return np.ascontiguousarray(np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").transpose(0, 2, 1))


def lookup_scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): inner products by lookups, plane by plane."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    for b in range(len(planes)):
        part = tables[0].take(planes[b, 0], axis=0)
        for g in range(1, len(tables)):
            part += tables[g].take(planes[b, g], axis=0)
        part <<= b
        if b == len(planes) - 1:  # two's complement: the last plane is the sign
            total -= part
        else:
            total += part
    return total


class _Best:
    """The first few of (score down, vec_id up with null last, uid up)."""

    def __init__(self, most: int):
        self.most, self.rows = most, None

    def least(self) -> int | None:
        return int(self.rows[0][-1]) if self.rows is not None and len(self.rows[0]) == self.most else None

    def offer(self, score, unnamed, vec, uid) -> None:
        if self.rows is not None:
            score, unnamed, vec, uid = (np.concatenate(x) for x in zip(self.rows, (score, unnamed, vec, uid)))
        if len(score) > self.most:  # of equal scores all stay until they are put in order
            few = np.flatnonzero(score >= np.partition(score, len(score) - self.most)[-self.most])
            score, unnamed, vec, uid = score[few], unnamed[few], vec[few], uid[few]
        order = np.lexsort((uid, vec, unnamed, -score))[:self.most]
        self.rows = score[order], unnamed[order], vec[order], uid[order]


# ------------------------------------------------------------------------ blocks
def quantised(vectors: DataFrame, anchor: Column) -> DataFrame:
    """uid, vec_id, label, anchor, q of the rows that take part."""
    x = F.col("embedding")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < TOO_LARGE))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                          F.col("label").cast("long").alias("label"))
    return (rows.where(F.col("label").isNotNull() & F.coalesce(fit, F.lit(False)))
            .select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", F.coalesce(anchor, F.lit(False)).alias("anchor"),
                    F.transform(x, lambda v: F.floor(v * SCALE).cast("int")).alias("q")))


def _matrix(q: pa.Array, dims: int) -> np.ndarray:
    lens = np.diff(q.offsets.to_numpy())
    out = np.zeros((len(lens), dims), np.int64)
    flat = q.flatten().to_numpy()
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def _long(x: pa.Array) -> np.ndarray:
    return x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


_ROWS = "c_uid binary, c_vec binary, c_unnamed binary, c_label binary, c_planes binary"


def _packed(rows: DataFrame, dims: int, planes: int) -> DataFrame:
    """Candidates in blocks: their keys and bit planes as bytes."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, CANDIDATE_BLOCK):
                b = batch.slice(lo, CANDIDATE_BLOCK)
                vec = b.column("vec_id")
                cells = (_long(b.column("uid")), _long(vec), vec.is_null().to_numpy(zero_copy_only=False).astype(np.int8),
                         _long(b.column("label")), bit_planes(_matrix(b.column("q"), dims), planes))
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells],
                                                 names=["c_uid", "c_vec", "c_unnamed", "c_label", "c_planes"])
    return rows.select("uid", "vec_id", "label", "q").mapInArrow(run, _ROWS)


def _anchor_blocks(rows: DataFrame, n: int, dims: int) -> DataFrame:
    """Anchors in blocks: keys, integers and the bounds their partners must keep
    (a row of ``bounds`` for each positive; none in the first search)."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ANCHOR_BLOCK):
                b = batch.slice(lo, ANCHOR_BLOCK)
                bounds = b.column("bounds")
                cells = (_long(b.column("uid")), _long(b.column("label")), _matrix(b.column("q"), dims),
                         np.diff(bounds.offsets.to_numpy()).astype(np.int64), _long(bounds.flatten()))
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells],
                                                 names=["a_uid", "a_label", "a_q", "a_bounds", "a_bound"])
    return (rows.select("uid", "label", "q", "bounds").repartition(max(1, -(-n // ANCHOR_BLOCK)), "uid")
            .mapInArrow(run, "a_uid binary, a_label binary, a_q binary, a_bounds binary, a_bound binary"))


def _search(candidates: DataFrame, anchors: DataFrame, dims: int, planes: int, most: int, least_percent: int, most_percent: int) -> DataFrame:
    """(anchor, slot, score, vec_id, uid): of every task the best rows of each
    anchor. Slot -1: other rows of the label; slot i: rows of other labels in the
    range that the anchor's i-th bound sets."""
    # Sums of products stay below this; 32 bits halve the tables where they do.
    width = np.int32 if max(dims, 1) << (2 * planes - 2) < 1 << 31 else np.int64

    def run(batches):
        best: dict[tuple[int, int], _Best] = {}
        known, tables = None, None
        for batch in batches:
            cells = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                def ints(name, kind=np.int64):
                    return np.frombuffer(cells[name][i].as_buffer(), kind)
                uid, vec, unnamed, label = ints("c_uid"), ints("c_vec"), ints("c_unnamed", np.int8), ints("c_label")
                a_uid, a_label, counts, bounds = ints("a_uid"), ints("a_label"), ints("a_bounds"), ints("a_bound")
                key = a_uid.tobytes()
                if key != known:  # most often one block of anchors meets many candidates
                    known, tables = key, subset_sums(ints("a_q").reshape(len(a_uid), dims).astype(width))
                score = np.ascontiguousarray(lookup_scores(tables, ints("c_planes", np.uint8).reshape(planes, dims // GROUP, -1)).T).astype(np.int64)
                ends = np.cumsum(counts)
                for a in range(len(a_uid)):
                    s, same = score[a], label == a_label[a]
                    if not counts[a]:
                        wanted = [(-1, same & (uid != a_uid[a]))]
                    else:
                        wanted = [(j, ~same & (100 * s >= least_percent * p) & (100 * s <= most_percent * p))
                                  for j, p in enumerate(bounds[ends[a] - counts[a]:ends[a]].tolist())]
                    for slot, fits in wanted:
                        kept = best.setdefault((int(a_uid[a]), slot), _Best(most))
                        if kept.least() is not None:
                            fits &= s >= kept.least()
                        at = np.flatnonzero(fits)
                        if len(at):
                            kept.offer(s[at], unnamed[at], vec[at], uid[at])
        for (a, slot), b in best.items():
            if b.rows is not None:
                s, unnamed, vec, uid = b.rows
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(s), a)), pa.array(np.full(len(s), slot, np.int32)), pa.array(s),
                    pa.array(vec, mask=unnamed.astype(bool)), pa.array(uid)], names=["anchor", "slot", "score", "vec_id", "uid"])
    return candidates.crossJoin(anchors).mapInArrow(run, "anchor long, slot int, score long, vec_id long, uid long")


def _first(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT) -> DataFrame:
    """For each anchor row (``anchor`` holds) and each of its best ``positives`` the
    best ``negatives`` of other labels that score from ``least_percent`` to
    ``most_percent`` of the positive. ``vectors`` has vec_id, embedding, label."""
    ship(vectors.sparkSession)
    rows = durable(quantised(vectors, anchor), "quantised")
    spread = rows.agg(F.max(F.size("q")).alias("dims"), F.max(F.array_max(F.transform("q", lambda v: F.greatest(v, -v - 1)))).alias("top"),
                      F.count_if("anchor").alias("anchors")).first()
    dims = max(1, -(-(spread.dims or 0) // GROUP)) * GROUP
    planes = int(spread.top or 0).bit_length() + 1  # and a sign
    candidates = durable(_packed(rows, dims, planes), "planes")
    of_anchor = rows.where("anchor").select("uid", "label", "q")
    search = dict(dims=dims, planes=planes, least_percent=least_percent, most_percent=most_percent)
    blocks = durable(_anchor_blocks(of_anchor.withColumn("bounds", F.array().cast("array<long>")), spread.anchors, dims), "anchors")
    best = durable(_first(_search(candidates, blocks, most=positives, **search), positives), "positives")
    bounds = best.groupBy(F.col("anchor").alias("uid")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("bounds"))
    ranged = durable(_anchor_blocks(of_anchor.join(bounds, "uid"), spread.anchors, dims), "anchors")
    found = durable(_first(_search(candidates, ranged, most=negatives, **search), negatives), "negatives")
    forget(candidates, blocks, ranged)
    chosen = best.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = rows.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")).where("anchor_id is not null")
    return (found.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(chosen, ["anchor", "slot"]).join(named, "anchor", "left")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vec = F.col("vec_id")
    label = F.col("label").cast("long")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives(vectors, vec % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * c.q[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank,
         other_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
