"""Ranked lexical search: Block-Max MaxScore over sharded inverted lists.

Index (:func:`build_index`). Documents are read in shards of bounded size; a
shard's lists hold, in blocks of 128 postings, variable-byte coded gaps and counts,
and for each block its last document and its competitive (count, length) pairs
(no other pair of the block has as many occurrences in as short a document). From
these the block's highest contribution follows exactly for any corpus statistics,
so that one pass over the texts is enough. The index is a table, one row for each
(shard, term) and one for each shard's documents; it does not depend on queries.

Search (:func:`search`). Query terms meet the index by a join on the term. For a
shard and a block of items, the lists of an item's terms are sorted by their global
bound (weight times the list's highest contribution). Lists are essential, and
read whole, until the bounds of the others add up to less than the k-th best score
so far. A candidate then gets the sum of its block maxima in the non-essential lists on
top; where that stays below the k-th best, it is rejected before any of these
blocks is decompressed, and again after each list. Shards' best rows are merged by
a window for each item, which cuts them in each task first.

Score: terms are the maximal runs of ASCII letters and digits and of all other
characters beyond ASCII, A-Z lowered. With N the documents that have a term, L all
their terms, n one document's, df the documents with a term and tf its count in
one: w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 10 + (90 n N) div L, and the
score is the sum of w * ((10 ** 9 tf) div (1000 tf + 8 m)), in 64-bit integers.

Skew: a term of any frequency is one row for each shard, and shards are bounded by
words (a longer document is a shard of its own). Items are dealt to blocks.

Defined results
- a null, empty or term-less text has no terms: it is not counted in N and never
  found; an item without terms has no rows;
- rows that repeat a doc_id are documents of their own; a null doc_id counts and
  can be found (last among equal scores);
- rows of items that share an item_id (or have none) are one item with all their terms;
- fewer documents with a score above 0 than asked for: all of them;
- extra columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, ship, table

BLOCK = 128
SHARD_WORDS = 2_000_000
SHARD_DOCS = 16_384
ITEM_BLOCK = 256
TOP = 10
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: On UTF-8: A-Z lowered, other ASCII marks and controls to blanks, all else stays.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))


# ------------------------------------------------------------------------- codes
def vbyte(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, least first, the top bit saying that more
    follow; and the end of each number."""
    size = np.ones(len(x), np.int64)
    for bits in range(7, 63, 7):
        more = x >= np.int64(1) << bits
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    for k in range(int(size.max()) if len(x) else 0):
        has = size > k
        out[ends[has] - size[has] + k] = ((x[has] >> (7 * k)) & 127) | ((size[has] > k + 1) << 7)
    return out, ends


def unvbyte(code: np.ndarray) -> np.ndarray:
    last = code < 128
    starts = np.r_[0, np.flatnonzero(last)[:-1] + 1]
    place = np.arange(len(code)) - np.repeat(starts, np.diff(np.r_[starts, len(code)]))
    return np.add.reduceat((code & 127).astype(np.int64) << (7 * place), starts)


def unpacked(code: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Documents and counts of one or more whole blocks (each but the last full)."""
    numbers = unvbyte(np.frombuffer(code, np.uint8))
    gaps, counts = numbers[::2], numbers[1::2]
    reached = np.cumsum(gaps)
    starts = np.arange(0, len(gaps), BLOCK)
    before = reached[starts] - gaps[starts]  # a block starts from document 0
    return reached - np.repeat(before, np.diff(np.r_[starts, len(gaps)])), counts


# ------------------------------------------------------------------------- index
_INDEX = ("shard long, term string, df int, occurrences long, postings binary, ends binary, lasts binary, "
          "best_tf binary, best_n binary, best_ends binary, doc_ids array<long>")


def _cells(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary cell for each stretch of ``data``."""
    at = np.r_[0, ends].astype(np.int64) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def shard_rows(shard: int, ids: list, lengths: np.ndarray, codes: np.ndarray, terms: list[bytes]) -> pa.RecordBatch:
    """The inverted lists of one shard: ``codes`` are the words of its documents,
    one document after the other, as numbers of ``terms``."""
    key, tf = np.unique((codes.astype(np.int64) << 32) | np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    code, doc = key >> 32, key & 0xFFFFFFFF
    heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    df = np.diff(np.r_[heads, len(code)])
    place = np.arange(len(code)) - np.repeat(heads, df)
    new = place % BLOCK == 0
    gap = doc - np.where(new, 0, np.r_[0, doc[:-1]])
    data, ends = vbyte(np.stack([gap, tf], 1).ravel())
    block = np.cumsum(new) - 1
    block_last = np.r_[np.flatnonzero(new)[1:], len(code)] - 1
    blocks_to = np.cumsum(-(-df // BLOCK))                                     # blocks up to the end of each term
    byte_ends = ends[1::2][block_last]
    byte_from = np.r_[0, byte_ends[blocks_to[:-1] - 1]]                        # first byte of each term
    within = byte_ends - np.repeat(byte_from, np.diff(np.r_[0, blocks_to]))
    # Competitive pairs: by count down, those in shorter documents than all before.
    n = lengths[doc]
    order = np.lexsort((n, -tf, block))
    beyond = np.int64(n.max()) + 1
    shifted = n[order] + (block[-1] - block[order]) * beyond                   # falls from block to block
    best = order[np.r_[True, shifted[1:] < np.minimum.accumulate(shifted)[:-1]]]
    best_to = np.searchsorted(block[best], np.arange(block[-1] + 1), side="right")
    best_from = np.r_[0, best_to[blocks_to[:-1] - 1]]
    best_within = best_to - np.repeat(best_from, np.diff(np.r_[0, blocks_to]))
    per_term = best_to[blocks_to - 1]
    rows = len(df)

    def with_docs(cells: pa.Array, of_docs) -> pa.Array:
        return pa.concat_arrays([cells, pa.array([of_docs], cells.type)])
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(rows + 1, shard, np.int64)), pa.array([t.decode() for t in terms] + [""]),
        pa.array(np.r_[df, len(ids)].astype(np.int32)), pa.array(np.r_[np.add.reduceat(tf, heads), lengths.sum()]),
        with_docs(_cells(data, byte_ends[blocks_to - 1]), None), with_docs(_cells(within.astype(np.uint32), blocks_to), None),
        with_docs(_cells(doc[block_last].astype(np.uint32), blocks_to), None), with_docs(_cells(tf[best].astype(np.uint32), per_term), None),
        with_docs(_cells(n[best].astype(np.uint32), per_term), lengths.astype(np.uint32).tobytes()),
        with_docs(_cells(best_within.astype(np.uint32), blocks_to), None),
        pa.concat_arrays([pa.nulls(rows, pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64()))])],
        names=[f.split()[0] for f in _INDEX.split(", ")])


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        number = self[term] = len(self)
        return number


def build_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text); write it before it is searched."""
    ship(docs.sparkSession)

    def run(batches):
        shard, ids, lengths, codes, held, known = TaskContext.get().partitionId() << 32, [], [], [], 0, _Numbers()

        def flush():
            return shard_rows(shard, ids, np.array(lengths, np.int64), np.concatenate(codes), list(known))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    words = (text or "").encode().translate(_FOLD).split()
                    if not words:
                        continue
                    if ids and (held + len(words) > SHARD_WORDS or len(ids) >= SHARD_DOCS):
                        yield flush()
                        shard, ids, lengths, codes, held, known = shard + 1, [], [], [], 0, _Numbers()
                    ids.append(doc)
                    lengths.append(len(words))
                    codes.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                    held += len(words)
        if ids:
            yield flush()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _INDEX)


# ------------------------------------------------------------------------ search
class _List:
    """An inverted list with its weight; blocks are decompressed when asked for."""

    def __init__(self, row: dict, weight: int, m_of_n, m_of_doc: np.ndarray):
        def ints(name):
            return np.frombuffer(row[name], np.uint32).astype(np.int64)
        self.code, self.ends, self.lasts = row["postings"], ints("ends"), ints("lasts")
        self.starts = np.r_[0, self.ends[:-1]]
        self.weight, self.m_of_doc = weight, m_of_doc
        at = ints("best_ends")
        self.maxima = np.maximum.reduceat(self._worth(ints("best_tf"), m_of_n(ints("best_n"))), np.r_[0, at[:-1]])
        self.bound = int(self.maxima.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.all = None

    def _worth(self, tf, m):
        return self.weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))

    def _read(self, blocks: np.ndarray):
        docs, tf = unpacked(b"".join(self.code[self.starts[b]:self.ends[b]] for b in blocks))
        return docs, self._worth(tf, self.m_of_doc[docs])

    def whole(self):
        if self.all is None:
            docs, tf = unpacked(self.code)
            self.all, self.open = (docs, self._worth(tf, self.m_of_doc[docs])), {}
        return self.all

    def block_of(self, docs: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lasts, docs)

    def worth_of(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Contributions to ``docs`` (ascending), which lie in ``blocks``."""
        if self.all is not None:
            held, worth = self.all
        else:
            wanted = np.unique(blocks[blocks < len(self.lasts)])
            for b in wanted:
                if int(b) not in self.open:
                    self.open[int(b)] = self._read([b])
            if not len(wanted):
                return np.zeros(len(docs), np.int64)
            held, worth = (np.concatenate(x) for x in zip(*(self.open[int(b)] for b in wanted)))
        at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
        return np.where(held[at] == docs, worth[at], 0)


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[-k]) if len(scores) >= k else 0


def best_of_shard(lists: list[_List], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that can be among the best k, with whole scores."""
    lists = sorted(lists, key=lambda x: -x.bound)
    rest = np.cumsum([x.bound for x in lists][::-1])[::-1].tolist() + [0]  # bounds from a list on
    score, least, essential = np.zeros(n_docs, np.int64), 0, 0
    while essential < len(lists) and (least == 0 or rest[essential] >= least):
        docs, worth = lists[essential].whole()
        score[docs] += worth
        essential += 1
        least = _kth(score, k)
    others = lists[essential:]
    docs = np.flatnonzero(score > max(0, least - rest[essential] - 1))
    reached = score[docs]
    if others and len(docs):
        blocks = [x.block_of(docs) for x in others]
        most = np.stack([np.r_[x.maxima, 0][b] for x, b in zip(others, blocks)])
        bound = reached + most.sum(0)
        for i, x in enumerate(others):
            stay = bound >= least
            docs, reached, bound, most = docs[stay], reached[stay], bound[stay], most[:, stay]
            blocks = [b[stay] for b in blocks]
            worth = x.worth_of(docs, blocks[i])
            reached = reached + worth
            bound = bound + worth - most[i]
            least = max(least, _kth(reached, k))
    stay = reached >= max(1, least)
    return docs[stay], reached[stay]


def _ranked(rows: pa.Table, n_docs_all: int, n_terms_all: int, k: int):
    """The best rows of one shard for a block of items."""
    cells = rows.to_pylist()
    own = next(r for r in cells if r["term"] == "")
    ids, lengths = own["doc_ids"], np.frombuffer(own["best_n"], np.uint32).astype(np.int64)

    def m_of_n(n):
        return 10 + (90 * n * n_docs_all) // n_terms_all
    m_of_doc = m_of_n(lengths)
    of_item: dict[int | None, list[_List]] = {}
    for r in cells:
        if r["term"]:
            x = _List(r, r["weight"], m_of_n, m_of_doc)
            for item in r["items"]:
                of_item.setdefault(item, []).append(x)
    out = []
    for item, lists in of_item.items():
        docs, scores = best_of_shard(lists, len(ids), k)
        found = sorted((-int(s), ids[d] is None, ids[d] or 0, int(d)) for s, d in zip(scores, docs))[:k]
        out += [(item, None if unnamed else doc, -s, own["shard"], place) for s, unnamed, doc, place in found]
    columns = list(zip(*out)) or [()] * 5
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score", "shard", "place"])


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the best k documents of each item (item_id, text)
    by the written ``index`` of :func:`build_index`."""
    spark = index.sparkSession
    ship(spark)
    totals = index.where("term = ''").agg(F.sum("df"), F.sum("occurrences")).first()
    n_docs, n_terms = (int(x or 0) for x in totals)
    blocks = max(1, -(-items.select("item_id").distinct().count() // ITEM_BLOCK))
    found = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    terms = (items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array_distinct(found)).alias("term")).distinct()
             .withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
             .groupBy("block", "term").agg(F.collect_list(F.struct("item_id"))["item_id"].alias("items")))  # within an item block
    terms = durable(terms, "query-terms")
    df = index.select("term", "df").join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum(F.col("df").cast("long")).alias("df"))
    weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = durable(terms.join(df, "term").select("block", "term", "items", weight.alias("weight")).where("weight > 0"), "query-terms")
    hits = index.join(weighed, "term")
    of_docs = (index.where("term = ''").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
               .withColumns({"items": F.array().cast("array<long>"), "weight": F.lit(0).cast("long")}))
    out = "item_id long, doc_id long, score long, shard long, place long"
    best = (hits.unionByName(of_docs.select(hits.columns)).groupBy("shard", "block")
            .applyInArrow(lambda t: _ranked(t, n_docs, n_terms, k), out))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "shard", "place")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    index = durable(build_index(table(spark, sf_dir, "documents")), "index")
    return search(index, table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), d AS (
  SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM t WHERE len(w) > 0
), c AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d
), f AS (
  SELECT doc_id, n, x, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(w) AS x FROM d) GROUP BY ALL
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM benchmark
), w AS (
  SELECT x, CAST(floor(1000 * ln((2 * c.docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, c GROUP BY x, c.docs
), s AS (
  SELECT q.item_id, f.doc_id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * f.n * c.docs) // c.terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (x) JOIN w USING (x), c GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
