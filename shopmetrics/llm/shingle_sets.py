"""Shingle sets, exact links within groups of them, and components: what the
near-duplicate operators share once they have found groups of candidates."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .common import durable, forget, small_enough
from .components import components

WORDS_KNOWN = 60_000


# ------------------------------------------------------------------- shingles
class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > WORDS_KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads sums of word hashes evenly."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words, A-Z lowered."""
    words = (text or "").encode().lower().split()  # on bytes: ASCII letters and blanks only
    if not words:
        return np.empty(0, np.uint64)
    known = _word_hashes()
    h = np.array([known[w] for w in words], dtype=np.uint64)
    run = min(width, len(h))
    mixed = np.full(len(h) - run + 1, run, np.uint64)
    for i in range(run):
        mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - run + 1 + i])
    return np.unique(mixed)


def digest_of(s: np.ndarray) -> bytes:
    import xxhash
    return xxhash.xxh3_128_digest(s.tobytes())


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(member, n, copies, set) of the wanted (node, digest, copies)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(small_enough(wanted, 64), "node")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
                good = pa.array([digest_of(s) == d for s, d in zip(sets, b.column("digest").to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([
                    b.column("digest"), pa.array([len(s) for s in sets], pa.int64()), b.column("copies"),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["member", "n", "copies", "set"]).filter(good)
    return rows.select("text", "digest", "copies").mapInArrow(run, "member binary, n long, copies long, set array<long>")


def _product(tile: pa.Table, percent: int) -> pa.Table:
    """(member, other, links) of the rows of a tile that have links in it."""
    seen, order = set(), []
    for i, m in enumerate(tile.column("member").to_pylist()):
        if m not in seen:  # one row of a set, should its document be there twice
            seen.add(m)
            order.append(i)
    tile = tile.take(order)
    side = tile.column("side").to_numpy()
    sets = tile.column("set").combine_chunks()
    values, ends = sets.values.to_numpy(), sets.offsets.to_numpy()
    sets = [values[ends[i]:ends[i + 1]] for i in range(len(side))]
    links = np.zeros((len(side), len(side)), bool)
    if side.any():
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side)
        if len(a):
            links[np.ix_(a, b)] = tiles.linked([sets[i] for i in a], [sets[i] for i in b], percent)
            links |= links.T
    else:
        links = tiles.linked(sets, None, percent)
    some = np.flatnonzero(links.any(1))
    to = tiles.roots(links)
    degree = links @ tile.column("copies").to_numpy()
    return pa.table([tile.column("member").take(some), tile.column("member").take(to[some]), pa.array(degree[some].astype(np.int64))],
                    names=["member", "other", "links"])


def exact_links(docs: DataFrame, wanted: DataFrame, width: int, percent: int, groups) -> DataFrame:
    """(member, other, links) by the exact similarity of whole sets: each row of
    ``wanted`` (node, digest, copies; a set and a document that has it) that has
    links, with one to the least set it reaches in a tile. ``groups`` makes the
    candidates' groups (member, group) of the table of sets."""
    sets = durable(whole_sets(docs, wanted, width), "sets")
    members = durable(sets.join(groups(sets), "member"), "members")
    links = durable(tiles.tiled(members, "group", percent).groupBy("tile").applyInArrow(
        lambda t: _product(t, percent), "member binary, other binary, links long"), "links")
    forget(sets, members)
    return links


def labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(digest, label, component_id, n_links) of the classes (node, digest, copies):
    the least set that each reaches and the least document that has one of those."""
    labels = components(links.where("member <> other").select(F.col("member").alias("a"), F.col("other").alias("b")))
    degree = links.groupBy("member").agg(F.sum("links").alias("links"))
    of_class = durable(classes.join(labels.select(F.col("node").alias("digest"), "label"), "digest", "left")
                       .join(degree.withColumnRenamed("member", "digest"), "digest", "left")
                       .select("digest", "node", F.coalesce("label", "digest").alias("label"),
                               (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "labels")
    least = of_class.groupBy("label").agg(F.min("node").alias("component_id"))
    return of_class.join(least, "label").select("digest", "label", "component_id", "n_links")
