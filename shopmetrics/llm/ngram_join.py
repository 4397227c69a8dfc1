"""Similarity join on word n-grams as a blocked sparse matrix product.

Documents by n-grams is a sparse 0/1 matrix A; A times its transpose holds the
overlap of every two documents. It is never formed whole:

1. Support. A is cut into row blocks (documents that are read together) and column
   blocks (ranges of the n-grams' 64-bit hashes). A column block finds the n-grams
   of more than one document; added up over the column blocks, each document gets
   the number of n-grams it shares with any other. A document with fewer than the
   overlap that its size asks for has no link and leaves; most do. A row block
   sends an n-gram that several of its documents have only once, so that a frequent
   one meets as few entries as there are blocks.
2. Copies. Documents with equal sets are one row from here on. The support is
   taken again over these rows, which leaves the sets near another one.
3. Groups. Two linked sets share one of the n - ceil(n * s) + 1 n-grams that are
   rarest in either; sets that share one of these are in one group.
4. Product. Each group is cut into tiles of bounded size (:mod:`.tiles`); a tile
   adds up the overlap counts by blocks of columns and discards pairs that can no
   longer reach the bound of their sizes. It returns for each row its number of
   links and a link to the least row it reaches, not the pairs.
5. Components by least label.

Skew: n-grams, copies and groups of any frequency are spread: 1. by row blocks, 2.
by aggregation with map-side combine and joins that adaptive execution splits, 4.
by tiles. A group of g different sets takes about (g / 512) ** 2 / 2 products.

Defined results
- words are runs of other characters than ASCII blanks, A-Z lowered; a text with
  fewer words than an n-gram has its whole sequence as one;
- null or blank-only text: no n-grams, linked with nothing, its own component;
- rows that repeat a doc_id are rows of their own, each with its links; the
  component is the least doc_id among the rows it reaches;
- a null doc_id cannot be named: component null, no links;
- ``n_links`` is the number of other rows that a row is linked with, copies included;
- extra columns are not read; an empty table gives an empty result.
Overlaps are counted on 64-bit hashes: two of the n-grams of one pair collide with
a probability of n ** 2 / 2 ** 64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, durable, forget, ship, table
from .components import components
from .shingle_sets import digest_of, exact_links, labelled, shingle_set

WIDTH, PERCENT = 4, 85
BLOCK_VALUES = 500_000   # n-grams of a row block; a longer document is a block of its own
BLOCK_ROWS = 60_000      # below what two bytes can name
SEVERAL = 0xFFFF         # instead of a row: more than one row of the block has the value

_BLOCKS = ("block long, part int, values binary, rows binary, doc_id array<long>, n array<int>, digest array<binary>, support array<int>")


def _row_block(block: int, ids: list, sets: list[np.ndarray], parts: int):
    """The entries of a row block by column block, and a row on its documents."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.r_[True, values[1:] != values[:-1]] if len(values) else np.empty(0, bool)
    of = np.cumsum(first) - 1
    several = np.bincount(of, minlength=0) > 1
    support = np.bincount(owner[several[of]], minlength=len(sets)) if len(values) else np.zeros(len(sets), np.int64)
    values, rows = values[first], np.where(several, SEVERAL, owner[first]).astype(np.uint16)
    part = ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # ascending, as the values are
    ends = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    low = values.view(np.uint8).reshape(-1, 8)[:, :6]  # the rest of the value is in the column block's number, but for a few bits
    here = np.flatnonzero(ends[1:] > ends[:-1])
    kinds = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32())
    own = [ids, sizes.tolist(), [digest_of(s) for s in sets], support.tolist()]
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(here) + 1, block, np.int64)), pa.array(np.r_[here, -1 - block % parts].astype(np.int32)),
        pa.array([low[ends[p]:ends[p + 1]].tobytes() for p in here] + [None], pa.binary()),
        pa.array([rows[ends[p]:ends[p + 1]].tobytes() for p in here] + [None], pa.binary()),
        *[pa.concat_arrays([pa.nulls(len(here), k), pa.array([x], k)]) for x, k in zip(own, kinds)]],
        names=["block", "part", "values", "rows", "doc_id", "n", "digest", "support"])


def _blocks(docs: DataFrame, width: int, parts: int) -> DataFrame:
    def run(batches):
        at, ids, sets, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    s = shingle_set(text, width)
                    if sets and (held + len(s) > BLOCK_VALUES or len(sets) >= BLOCK_ROWS):
                        yield _row_block(at, ids, sets, parts)
                        at, ids, sets, held = at + 1, [], [], 0
                    ids.append(doc)
                    sets.append(s)
                    held += len(s)
        if sets:
            yield _row_block(at, ids, sets, parts)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCKS)


def supported(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, digest, support of every row: how many of its n values another
    row has too (a few too many where hashes of 48 bits and the part collide)."""
    ship(docs.sparkSession)

    def shared(part: pa.Table) -> pa.Table:
        if part.column("part")[0].as_py() < 0:  # rows on documents pass
            return part.select(["block", "values", "doc_id", "n", "digest", "support"])
        cells = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 6) for x in part.column("values")]
        counts = [len(c) for c in cells]
        wide = np.zeros((sum(counts), 8), np.uint8)
        np.concatenate(cells, out=wide[:, :6])
        rows = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in part.column("rows")])
        order = np.argsort(wide.view(np.uint64).ravel(), kind="stable")
        v = wide.view(np.uint64).ravel()[order]
        same = v[1:] == v[:-1]
        hit = np.zeros(len(v), bool)
        hit[order] = np.r_[same, False] | np.r_[False, same]
        hit &= rows != SEVERAL  # those are counted in their block
        of = np.repeat(np.arange(len(counts)), counts)
        ends = np.searchsorted(of[hit], np.arange(len(counts) + 1))
        hits = rows[hit]
        none = part.select(["doc_id", "n", "digest", "support"])
        return pa.table([part.column("block"), pa.array([hits[ends[i]:ends[i + 1]].tobytes() for i in range(len(counts))], pa.binary()),
                         *none.columns], names=["block", "values", *none.column_names])

    def summed(block: pa.Table) -> pa.Table:
        hits, base = [], None
        for x, n in zip(block.column("values"), block.column("n")):
            if n.is_valid:
                base = len(hits)
            hits.append(np.frombuffer(x.as_buffer(), np.uint16) if x.is_valid else np.empty(0, np.uint16))
        own = block.slice(base, 1)
        support = own.column("support").combine_chunks().flatten().to_numpy()
        total = support + np.bincount(np.concatenate(hits), minlength=len(support))
        return pa.table([own.column(c).combine_chunks().flatten() for c in ("doc_id", "n", "digest")] + [pa.array(total.astype(np.int32))],
                        names=["doc_id", "n", "digest", "support"])
    found = _blocks(docs, width, buckets(docs.sparkSession, 2)).groupBy("part").applyInArrow(
        shared, "block long, values binary, doc_id array<long>, n array<int>, digest array<binary>, support array<int>")
    return found.groupBy("block").applyInArrow(summed, "doc_id long, n int, digest binary, support int")


def _groups(sets: DataFrame, percent: int) -> DataFrame:
    """(member, group): sets that share a value among the rarest of either."""
    entries = sets.select("member", "n", F.explode("set").alias("value"))
    often = entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = (entries.join(often, "value").groupBy("member", "n")
            .agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("held")))  # of one set
    least = F.floor((F.col("n") * percent + 99) / 100)
    alone = F.col("n") - F.size("held")  # values no other set has are the rarest
    take = F.greatest(F.lit(0), F.col("n") - least + 1 - alone).cast("int")
    rare = durable(held.where(F.size("held") >= least).select("member", F.explode(F.slice("held", F.lit(1), take)["value"]).alias("value")), "rare")
    hubs = rare.groupBy("value").agg(F.min("member").alias("hub"))
    links = durable(rare.join(hubs, "value").where("member <> hub").select(F.col("member").alias("a"), F.col("hub").alias("b")).distinct(), "rare-links")
    groups = components(links)
    forget(rare, links)
    return groups.select(F.col("node").alias("member"), F.col("label").alias("group"))


def ngram_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of ``docs``."""
    rows = durable(supported(docs, width), "supported")
    near = rows.where((F.col("support") * 100 >= F.col("n") * percent) & (F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = durable(near.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")), "classes")
    links = exact_links(docs, classes, width, percent, lambda sets: _groups(sets, percent))
    named = labelled(classes, links)
    forget(classes, links)
    key = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest"))
    return (rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), key.alias("digest")).join(named, "digest", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def op12_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 2),
                                                 lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS seen FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.seen
), m AS (
  SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id
), k AS (
  SELECT a AS doc_id, count(*) AS n_links FROM p GROUP BY a
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id, coalesce(k.n_links, 0) AS n_links
FROM s JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
"""
