"""Exact dedup by progressive refinement (DataFrame functions only).

Level 1 groups texts by length, level 2 by (length, hash of a prefix); both are
cheap keys and are counted in one pass over small rows. Level 3 reads whole
texts: only rows whose (length, prefix hash) occurs more than once are hashed
in full (SHA-256) and grouped by that hash. Texts alone in their length or
prefix group are unique and are never hashed by the operator.

Plan: one narrow aggregation; a left join of the rows with the surviving keys
(Spark broadcasts them if their measured size allows, else a shuffled join
whose hot keys adaptive execution splits); one aggregation with map-side
combine of (length, hash) and a join back of narrow rows. No task holds a group
and no text crosses the last two shuffles.

Defined results
- null text counts as empty; empty and blank-only texts are ordinary texts;
- a null id never is the smallest one; a group with null ids only has a null
  ``keep_id`` and keeps one of its rows;
- rows that repeat id and text count in ``group_size``; one of them is kept;
- rows with one id and different texts are different rows;
- other columns, whatever their names, are not read; an empty table gives an
  empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, one_space, own_names, table, text_or_empty

PREFIX_CHARS = 128


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 prefix_chars: int = PREFIX_CHARS, carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, *carry) for every row of ``docs``.

    ``carry`` holds expressions over ``_norm`` (the normalised text), computed
    while the text is at hand."""
    carry = carry or {}
    texts = docs.select(F.col(id_col).alias("_id"), one_space(text_or_empty(text_col)).alias("_norm"))
    keyed = texts.select("*", F.length("_norm").alias("_chars"),
                         F.xxhash64(F.substring("_norm", 1, prefix_chars)).alias("_prefix"))
    # A (length, prefix) group of several rows lies in a length group of several
    # rows, so one count serves both levels.
    survivors = (keyed.groupBy("_chars", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
                 .where("_n > 1").select("_chars", "_prefix", F.lit(True).alias("_again")))
    full = F.when(F.col("_again"), F.unhex(F.sha2("_norm", 256)))
    rows = durable(keyed.join(survivors, ["_chars", "_prefix"], "left")
                   .select("_id", "_chars", full.alias("_full"), *[e.alias(n) for n, e in carry.items()]))
    groups = (rows.where(F.col("_full").isNotNull()).groupBy("_chars", "_full")
              .agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
              .where("_size > 1"))
    same = Window.partitionBy("_chars", "_full", "_id").orderBy(F.lit(0))
    grouped = rows.join(groups, ["_chars", "_full"], "left")
    # Rows that repeat id and text are interchangeable: number them, keep the first.
    repeated = grouped.where("_size > 1").withColumn("_copy", F.row_number().over(same))
    alone = grouped.where("_size is null").withColumn("_copy", F.lit(1))
    out = alone.unionByName(repeated)
    return out.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_size") > 1, F.col("_keep")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        ((F.col("_copy") == 1) & (F.col("_size").isNull() | F.col("_id").eqNullSafe(F.col("_keep")))).alias("kept"),
        *carry)


def digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(table(spark, sf_dir, "documents"),
                        carry={"text_sha256": digest(F.col("_norm"))})


def drop_exact_copies(spark, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """``docs`` without the rows the operator drops (pipeline stage).

    The dropped (id, hash) keys are anti-joined, then one of the rows that
    repeat id and text is taken; both need the same partitioning, so the texts
    cross one shuffle."""
    found = exact_groups(docs.select("doc_id", "text"), carry={"_sha": digest(F.col("_norm"))})
    gone = (found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
            .select(F.col("doc_id").alias("gone"), F.col("_sha").alias("gone_sha")).distinct())
    sha, copy = own_names(docs, "_sha", "_copy")  # columns of ``docs`` may have any names
    named = docs.withColumn(sha, digest(one_space(text_or_empty("text"))))
    left = named.join(gone, named["doc_id"].eqNullSafe(gone["gone"]) & (named[sha] == gone["gone_sha"]), "left_anti")
    one = Window.partitionBy("doc_id", sha).orderBy(F.lit(0))
    return left.withColumn(copy, F.row_number().over(one)).where(F.col(copy) == 1).drop(copy, sha)


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
