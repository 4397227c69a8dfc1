"""Verbatim passages of ``WIDTH`` words, wherever they start and end.

A word is a run of non-blanks. Of all windows of ``WIDTH`` words that occur more
than once, the first by (doc_id, text hash, place) is the original; the words of
the others are reported. Hashing every window of every text into a shuffle would move many
times the input, so windows are sieved first (winnowing): a window's anchor is
the least hash of its runs of ``GRAM`` words. Equal windows have equal anchors,
so a window whose anchor occurs at one place only is unique. Only the windows of
anchors that occur again are hashed (96 bits) and compared; nothing is lost.

Word, run and window hashes are differences of running sums modulo 2**64, taken
for many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, ship

WIDTH = 50
GRAM = 8
_SLICE_BYTES = 4 << 20
_RND = np.random.default_rng(20240607)
_BYTES = _RND.integers(1, 1 << 63, 256, dtype=np.uint64)
# Odd factors have an inverse modulo 2**64.
_FACTORS = [int(x) | 1 for x in _RND.integers(1 << 40, 1 << 62, 4, dtype=np.uint64)]
_POWERS: dict[int, np.ndarray] = {}
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(factor: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``factor`` at least."""
    have = _POWERS.get(factor)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), factor, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 2 * _SLICE_BYTES:  # a longer text's are not kept
            _POWERS[factor] = have
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, factor: int) -> np.ndarray:
    """Hash of ``values[start:end]`` for each start and end."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers(factor, n), out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * _powers(pow(factor, -1, 1 << 64), n)[starts])


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours."""
    at, out = 1, values
    while 2 * at <= width:
        out = pick(out[:-at], out[at:])
        at *= 2
    return pick(out[:len(out) - (width - at)], out[width - at:]) if at < width else out


class Words:
    """Words and windows of texts that lie one after the other in ``data``, text
    i from byte ``bounds[i]`` to ``bounds[i + 1]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, width: int, gram: int):
        self.width, self.gram = width, gram
        solid = np.ones(len(data) + 2, dtype=bool)
        solid[0] = solid[-1] = False
        solid[1:-1] = (data != 32) & ((data < 9) | (data > 13))
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        self.starts = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
        self.ends = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
        self.row = np.searchsorted(bounds, self.starts, side="right") - 1
        self.words = _run_hashes(_BYTES[data], self.starts, self.ends, _FACTORS[0])
        n = len(self.words)
        first = np.arange(max(0, n - width + 1))
        self.whole = self.row[first] == self.row[first + width - 1]  # windows inside one text
        if len(first):
            at = np.arange(n - gram + 1)
            self.grams = _run_hashes(self.words, at, at + gram, _FACTORS[1])
            self.least = _sliding(self.grams, width - gram + 1, np.minimum)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every run that is the least of some window."""
        if not self.whole.any():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        pad = np.zeros(self.width - self.gram, dtype=np.uint64)
        most = _sliding(np.concatenate([pad, np.where(self.whole, self.least, np.uint64(0)), pad]), len(pad) + 1, np.maximum)
        at = np.flatnonzero(most == self.grams)
        return self.row[at], self.grams[at].view(np.int64)

    def windows(self, wanted: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(text, place, two hashes) of the windows whose anchor is among those
        wanted in their text."""
        take = self.whole.copy()
        if len(take):
            cuts = np.searchsorted(self.row[:len(take)], np.arange(len(wanted) + 1))
            for i, some in enumerate(wanted):
                a, b = cuts[i], cuts[i + 1]
                take[a:b] &= np.isin(self.least[a:b].view(np.int64), some)
        at = np.flatnonzero(take)
        begin = np.searchsorted(self.row, self.row[at])  # the text's first word
        low, high = (_run_hashes(self.words, at, at + self.width, f).view(np.int64) for f in _FACTORS[2:])
        return self.row[at], (at - begin).astype(np.int32), low, (high >> 32).astype(np.int32)


def _slices(batch: pa.RecordBatch, width: int, gram: int) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of parts of the batch with few bytes each."""
    text = batch.column("text").cast(pa.large_string())
    _, places, raw = text.buffers()
    bounds = np.frombuffer(places, dtype=np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + _SLICE_BYTES, side="right")) - 1)
        yield a, b, Words(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a], width, gram)
        a = b


def _anchor_rows(width: int, gram: int):
    def run(batches):
        for batch in batches:
            for a, b, words in _slices(batch, width, gram):
                row, anchor = words.anchors()
                own = batch.slice(a, b - a).select(["doc_id", "doc_hash"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(anchor)], names=["doc_id", "doc_hash", "anchor"])
    return run


def _window_rows(width: int, gram: int):
    def run(batches):
        for batch in batches:
            lists = batch.column("anchors")
            for a, b, words in _slices(batch, width, gram):
                row, *found = words.windows([lists[i].values.to_numpy() for i in range(a, b)])
                own = batch.slice(a, b - a).column("no").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([own, *map(pa.array, found)], names=["no", "at", "low", "high"])
    return run


def repeated_passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, doc_hash, ranges): ranges of words (struct<start, end>) to remove,
    per document, from ``docs`` (doc_id, doc_hash, text without nulls)."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "doc_hash", "text")
    anchors = durable(docs.mapInArrow(_anchor_rows(width, gram), "doc_id long, doc_hash long, anchor long"), "anchors")
    again = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    lists = anchors.join(again, "anchor").groupBy("doc_id", "doc_hash").agg(F.array_sort(F.collect_set("anchor")).alias("anchors"))
    # ``no`` numbers the documents in their order, in one column.
    wanted = durable(lists.withColumn("unnamed", F.col("doc_id").isNull()).orderBy("unnamed", "doc_id", "doc_hash")
                     .withColumn("no", F.monotonically_increasing_id()).withColumn("set_hash", F.xxhash64("anchors")), "wanted")
    # A text that an earlier document holds too goes whole, without its windows.
    copies = wanted.groupBy("doc_hash", "set_hash").agg(F.min("no").alias("head"))
    marked = wanted.join(copies, ["doc_hash", "set_hash"])
    whole = marked.where("no > head").select("doc_id", "doc_hash", F.array(F.struct(
        F.lit(0).cast("long").alias("start"), F.lit((1 << 63) - 1).cast("long").alias("end"))).alias("ranges"))
    heads = marked.where("no = head").select(F.col("doc_id").alias("_d"), F.col("doc_hash").alias("_h"), "no", "anchors")
    some = (docs.join(heads, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("doc_hash") == F.col("_h")))
            .select("no", "text", "anchors"))
    windows = some.mapInArrow(_window_rows(width, gram), "no long, at int, low long, high int")
    first = (windows.groupBy("low", "high").agg(F.min(F.struct("no", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("low", "high", "first"))
    later = windows.join(first, ["low", "high"]).where(F.struct("no", "at") != F.col("first"))
    # The original stays whole where a later window of its text overlaps it.
    start = F.when(F.col("no") == F.col("first.no"), F.greatest(F.col("at"), F.col("first.at") + width)).otherwise(F.col("at"))
    ranges = later.groupBy("no").agg(F.collect_list(F.struct(
        start.cast("long").alias("start"), (F.col("at") + width).cast("long").alias("end"))).alias("ranges"))
    return wanted.join(ranges, "no").select("doc_id", "doc_hash", "ranges").unionByName(whole)
