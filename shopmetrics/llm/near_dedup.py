"""MinHash near-dedup with bottom-k sketches.

One hash function maps each shingle to 64 bits; a document's sketch is its k
least values. Documents with equal sets form one class and go on as one.

1. Inverted lists. Values held by one class only are dropped. Of the others a
   class keeps those that are rarest over the corpus: two classes with similarity
   s share at least t of their k values, so they share one of the k - t + 1
   rarest (t is exact while sketches hold whole sets; beyond, the number shared
   is about binomial(k, s), and t = 17 of 32 misses a pair of similarity 0.8
   with a probability of about 2e-4, fewer above).
2. Overlaps and estimates. The lists are compared inside tasks: members of a list
   whose sketches overlap enough get the union-sketch estimate (of the k least
   values of both, the share that both hold). A task returns of the pairs that pass
   only a spanning forest; what these connect is a group.
3. Exact Jaccard on full sets, within the groups, in tiles of bounded size; links
   again leave as a forest.
4. Components by least label. Every document gets its class's label.

Skew: lists of more than ``tiles.ROWS`` members and groups of any size are cut into
tiles, classes are spread by joins that adaptive execution splits and by
aggregations with map-side combine. No pair of documents is a row of its own, and
no cap is set on members or candidates.

Defined results
- null or blank-only text: no shingles, linked with nothing, its own component;
- texts with fewer words than a shingle have their whole sequence as one;
- rows that repeat a doc_id are rows of their own, each linked by its own text;
- a null doc_id cannot be named: component null, kept, linked with nothing;
- extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .common import buckets, durable, forget, ship, table
from .components import components
from .shingle_sets import digest_of, exact_links, labelled, shingle_set

K = 32
SHARED = 17            # t for sketches that do not hold the whole set
PERCENT = 80           # similarity that links
ESTIMATE_PERCENT = 53  # union-sketch estimate that goes on to the exact test


def sketch_rows(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, text_hash, n (set size), digest of the set, sketch (k least values, ascending)."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingle_set(t, width) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest_of(s) for s in sets], pa.binary()),
                    pa.array([s[:k].view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "n", "digest", "sketch"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, n long, digest binary, sketch array<long>")


# ---------------------------------------------------------------------- lists
def inverted_lists(classes: DataFrame, k: int, shared: int, percent: int) -> DataFrame:
    """(value, df, member, n, sketch): the values that can lead to a link. Sketches
    go on as the upper 32 bits of each value, which keep its order."""
    values = classes.select("member", "n", F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = (values.join(often, "value").groupBy("member", "n")
            .agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("held")))  # k at most
    kept = F.least("n", F.lit(k))
    # Both sets are whole in their sketches up to this size, at the similarity asked for.
    whole = F.col("n") * 100 <= F.lit(k * percent)
    least = F.when(whole, F.ceil(F.col("n") * percent / 100)).otherwise(F.least("n", F.lit(shared)))
    alone = kept - F.size("held")  # values no other class holds are the rarest
    take = F.greatest(F.lit(0), kept - least + 1 - alone).cast("int")
    brief = F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int"))
    return (held.where(take > 0).select("member", "n", F.slice("held", F.lit(1), take).alias("held"))
            .join(classes.select("member", brief.alias("sketch")), "member")
            .select("member", "n", "sketch", F.explode("held").alias("x"))
            .select(F.col("x.value").alias("value"), F.col("x.df").alias("df"), "member", "n", "sketch"))


def estimates(sketches: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Of the pairs (rows a, rows b), those whose k least values of the union lie in
    both sketches often enough. Rows are filled up with the greatest number."""
    both = np.sort(np.concatenate([sketches[a], sketches[b]], axis=1), axis=1)
    filled = (sizes[a] + sizes[b])[:, None] > np.arange(both.shape[1])[None, :]
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = both[:, 1:] == both[:, :-1]
    place = np.cumsum(~twice, axis=1)  # of each value among the distinct ones
    among = (place <= k) & filled
    return 100 * (among & twice).sum(1) >= percent * (among & ~twice).sum(1)


def _forest(rows: pa.Table, k: int, percent: int, least_percent: int) -> pa.Table:
    """(a, b): each member and the least one that it is connected with by pairs that
    share a list of the task (or lie on the two sides of a tile) and pass the estimate."""
    value, member, n = (rows.column(c).to_numpy() for c in ("value", "member", "n"))
    side = rows.column("side").to_numpy()
    order = np.lexsort((member, value))
    value, member, n, side = value[order], member[order], n[order], side[order]
    cells = rows.column("sketch").combine_chunks().take(pa.array(order))
    sizes = np.diff(cells.offsets.to_numpy())
    sketches = np.full((len(order), k), np.iinfo(np.int64).max)
    sketches[np.repeat(np.arange(len(order)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = cells.flatten().to_numpy()
    named, at = np.unique(member, return_inverse=True)
    first = np.zeros(len(named), np.int64)
    first[at[::-1]] = np.arange(len(order))[::-1]
    sketches, sizes, n = sketches[first], sizes[first], n[first]
    up = list(range(len(named)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    starts = np.r_[np.flatnonzero(np.r_[True, value[1:] != value[:-1]]), len(value)]
    done = np.empty(0, np.int64)

    def test(a, b):
        """Pairs of one step: those not connected by earlier steps are estimated."""
        label = np.array([root(x) for x in range(len(up))]) if len(a) > len(up) else None
        apart = label[a] != label[b] if label is not None else np.array([root(x) != root(y) for x, y in zip(a.tolist(), b.tolist())], bool)
        a, b = a[apart], b[apart]
        near = 100 * np.minimum(n[a], n[b]) >= least_percent * np.maximum(n[a], n[b])
        a, b = a[near], b[near]
        for lo in range(0, len(a), 4096):
            x, y = a[lo:lo + 4096], b[lo:lo + 4096]
            good = estimates(sketches, sizes, x, y, k, percent)
            for i, j in zip(x[good].tolist(), y[good].tolist()):
                ri, rj = root(i), root(j)
                if ri != rj:
                    up[max(ri, rj)] = min(ri, rj)
    lengths = np.diff(starts)
    # Pairs by their distance in the list, over all lists at once: those at one step
    # are as many as there are members, and most are connected after a few steps.
    for step in range(1, int(lengths.max(initial=1))):
        long_enough = starts[:-1][lengths > step]
        ends = starts[1:][lengths > step]
        lo = np.concatenate([np.arange(s, e - step) for s, e in zip(long_enough, ends)])
        lo = lo[side[lo] != side[lo + step]] if side.any() else lo
        pairs = np.unique(at[lo] * len(named) + at[lo + step])
        if step < 8:  # neighbours in one list often are in others
            pairs = np.setdiff1d(pairs, done, assume_unique=True)
            done = np.union1d(done, pairs)
        test(*np.divmod(pairs, len(named)))
    # To the least member: tasks that see the same group then mostly say the same.
    least = np.array([root(x) for x in range(len(up))], np.int64)
    a = np.flatnonzero(least != np.arange(len(up)))
    return pa.table([pa.array(named[a]), pa.array(named[least[a]])], names=["a", "b"])


def estimated_groups(classes: DataFrame, k: int, shared: int, percent: int, estimate_percent: int) -> DataFrame:
    """(member, group): classes that are connected by pairs which pass the estimate."""
    lists = durable(inverted_lists(classes, k, shared, percent), "lists")

    def forest(rows):
        return _forest(rows, k, estimate_percent, percent)
    # Short lists are compared many to a task, long ones in tiles.
    bundle = F.pmod(F.xxhash64("value"), F.lit(buckets(classes.sparkSession)))
    short = lists.where(F.col("df") <= tiles.ROWS).withColumns({"bundle": bundle, "side": F.lit(0)})
    long_lists = tiles.tiled(lists.where(F.col("df") > tiles.ROWS).withColumn("list", F.col("value")), "list", percent)
    edges = (short.groupBy("bundle").applyInArrow(forest, "a long, b long")
             .unionByName(long_lists.groupBy("tile").applyInArrow(forest, "a long, b long")))
    edges = durable(edges.distinct(), "estimated")
    groups = components(edges)
    forget(lists, edges)
    return groups.select(F.col("node").alias("member"), F.col("label").alias("group"))


def near_rows(docs: DataFrame, width: int = 2, k: int = K, shared: int = SHARED, percent: int = PERCENT,
              estimate_percent: int = ESTIMATE_PERCENT) -> DataFrame:
    """doc_id, text_hash, n, label (of the component's sets), component_id of every row."""
    rows = durable(sketch_rows(docs, width, k), "sketches")
    one = F.min(F.struct("doc_id", "n", "sketch"))
    classes = durable(rows.where("doc_id is not null and n > 0").groupBy("digest").agg(one.alias("x"), F.count(F.lit(1)).alias("copies"))
                      .select(F.monotonically_increasing_id().alias("member"), "digest", F.col("x.doc_id").alias("node"), "x.n", "x.sketch", "copies"), "classes")
    groups = durable(estimated_groups(classes, k, shared, percent, estimate_percent).join(classes, "member")
                     .select("digest", "node", "copies", "group"), "groups")
    of_set = groups.select(F.col("digest").alias("member"), "group")
    links = exact_links(docs, groups.select("node", "digest", "copies"), width, percent, lambda _: of_set)
    named = labelled(classes.select("digest", "node", "copies"), links)
    forget(groups, links)
    key = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest"))
    return (rows.select("doc_id", "text_hash", "n", key.alias("digest")).join(named, "digest", "left")
            .select("doc_id", "text_hash", "n", "label", F.coalesce("component_id", "doc_id").alias("component_id")))


def near_components(docs: DataFrame, width: int = 2, **more) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    return near_rows(docs, width, **more).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def drop_near_copies(spark, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """``docs`` with one document of each group (pipeline stage). Links are on
    shingles of five words at a similarity of 0.8 or more. A row is known by its
    doc_id and its text: of a component the row that is least by both stays, with
    any that repeat it; a row with the doc_id of a dropped one, but another text,
    is not touched. Columns of ``docs`` may have any names."""
    rows = near_rows(docs, width=5).where("label is not null")
    name = F.struct(F.col("doc_id"), F.col("text_hash"))
    first = rows.groupBy("label").agg(F.min(name).alias("first"))
    gone = durable(rows.join(first, "label").where(name != F.col("first")).select("doc_id", "text_hash").distinct(), "gone")
    id_of, text = docs["doc_id"].cast("long"), F.xxhash64(docs["text"])
    return docs.join(gone, (id_of == gone["doc_id"]) & (text == gone["text_hash"]), "left_anti")


# All pairs that share a shingle, with exact set sizes.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))
                      ELSE w END AS sh FROM d
), c AS (
  SELECT min(doc_id) AS node, sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh
), e AS (
  SELECT node, n, unnest(sh) AS x FROM c
), p AS (
  SELECT a.node AS a, b.node AS b
  FROM e a JOIN e b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), l AS (
  SELECT a, b FROM p UNION SELECT b, a FROM p
), r AS (
  SELECT node, node AS seen FROM c UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen
), m AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY node
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id,
       s.doc_id = coalesce(m.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.sh = s.sh LEFT JOIN m ON m.node = c.node
"""
