"""Best-fit packing of token pieces into sequences (best-two-fit).

Documents become token ids plus an end mark; only longer ones are cut into
pieces of ``capacity`` tokens, the first piece taking the remainder. Pieces are
then packed by length: lengths are integers from 1 to ``capacity``, so the
packer works on a histogram of at most ``capacity`` counts and never on pieces.

Planning (driver, size bounded by ``capacity`` alone): open a bin with the
longest piece left and fill it greedily, always with the longest that fits.
Then take the bin's smallest piece out and look for two unpacked pieces that
fill the widened gap more tightly; if there are, they replace it. The bin so
found is a pattern of lengths, repeated as often as the counts allow at once,
which is what filling bin after bin would do. Each pattern exhausts some length
or brings it below one bin's need, so the plan's size follows ``capacity``.

Placement (Spark): pieces are numbered within their length by salted counts
(no task holds a length, however common), and (length, number) is looked up in
the plan, whose arrays are the only thing sent to the tasks.

Defined results
- null and empty texts: the end mark alone, one piece of length 1;
- texts of any length are tokenised whole; rows that repeat a doc_id or a text
  are packed each on their own; ties in length are ordered by doc_id, piece;
- an empty table gives no sequence; extra columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, durable, kept, rank_within, ship, table
from .text_cuts import CutMemo, plain

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
JOINED = 2_000  # words that are encoded as one text
PORTION = 4 << 20  # bytes of text that are encoded at a time, or one text; each looks up a word once
_BLANKS = ("\u0120", "\u010a")  # space and line feed, as byte-level vocabularies write them
CACHE = 200_000  # texts between blanks whose ids a worker remembers, twice at most (about 200 bytes each, so 80 MB)


# ------------------------------------------------------------------ tokens
class Encoder:
    """Ids of whole texts, as ``tokenizers`` gives them, through a bounded memo of cuts."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        # Strings of special tokens in a text get the special ids, as the library has
        # it; a cut could part or join them, so such texts are encoded whole.
        self._special = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        vocabulary = self._tok.get_vocab()
        self._begins = np.zeros(1 + max(vocabulary.values()), bool)  # tokens whose first byte is a space or line feed
        self._begins[[i for t, i in vocabulary.items() if t[:1] in _BLANKS]] = True
        self._memo = CutMemo(self._learn, cache)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in self._ids(parts)]

    def _learn_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that follow a blank (a space, if they hold none). They are
        joined: each begins at a token that begins with a blank, as no other does."""
        out: list[bytes] = []
        for lo in range(0, len(words), JOINED):
            some = words[lo:lo + JOINED]
            ids = np.array(self._ids([(" " + " ".join(some)).replace(" \n", "\n")])[0], "<u4")
            begins = np.flatnonzero(self._begins[ids])
            if len(begins) == len(some):
                raw, at = ids.tobytes(), [*(4 * begins).tolist(), 4 * len(ids)]
                out += [raw[i:j] for i, j in zip(at, at[1:])]
            else:  # another kind of vocabulary
                out += self._learn(list(map(plain, some)))
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls), one after the other, and how many each has."""
        odd = np.zeros(len(texts), bool)
        for s in self._special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(odd)
        cuts = pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts) if len(rows) else texts
        values, place, sizes = self._memo.of_column(cuts, self._learn_words)
        if len(rows):
            place = np.insert(place, np.cumsum(sizes)[rows], len(values) + np.arange(len(rows)))
            sizes[rows] = 1
            values += self._learn(texts.take(pa.array(rows)).to_pylist())
        counts = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids = np.frombuffer(b"".join(values), "<u4")
        n = counts[place]
        stops = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat((np.cumsum(counts) - counts)[place] - stops[:-1], n) + np.arange(stops[-1])]
        return flat, np.diff(stops[np.concatenate([[0], np.cumsum(sizes)])])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        flat, counts = self.encode_column(pa.array(texts, pa.string()))
        stops = np.cumsum(counts)
        return (flat[i:j].tobytes() for i, j in zip(stops - counts, stops))


@kept
def _encoder(path: str) -> Encoder:
    """A worker process keeps its encoder, and so its memo, from task to task."""
    return Encoder(path)


def portions(texts: pa.Array, most: int = PORTION) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) rows of portions of about ``most`` bytes."""
    stops = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    lo = 0
    while lo < len(stops):
        stop = max(lo + 1, int(np.searchsorted(stops, (stops[lo - 1] if lo else 0) + most, side="right")))
        yield lo, stop
        lo = stop


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32[, ids]."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    end = int(end_id).to_bytes(4, "little")
    ship(docs.sparkSession)

    def cut(batches):
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "")
            for lo, stop_row in portions(texts):
                out: list[list] = [[], [], [], [], []]
                ids_out = []
                flat, counts = encoder.encode_column(texts.slice(lo, stop_row - lo))
                raw, at = flat.tobytes(), 0
                for doc_id, n in zip(doc_ids[lo:stop_row], counts.tolist()):
                    ids = raw[at:at + 4 * n] + end
                    at += 4 * n
                    n += 1
                    first = n % capacity or capacity
                    start = 0
                    for piece, stop in enumerate(range(first, n + 1, capacity)):
                        own = ids[4 * start:4 * stop]
                        for column, value in zip(out, (doc_id, piece, start, stop - start, zlib.crc32(own))):
                            column.append(value)
                        if with_ids:
                            ids_out.append(np.frombuffer(own, dtype="<i4"))
                        start = stop
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(c, t) for c, t in zip(out, types)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


# -------------------------------------------------------------------- plan
def _best_two(counts: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Two unpacked lengths of largest sum up to ``gap``; the longer first."""
    best = None
    for a in np.flatnonzero(counts[:gap])[::-1]:  # a <= gap - 1
        a = int(a)
        if a == 0 or (best and 2 * a <= sum(best)):
            break
        room = min(gap - a, a)
        have = np.flatnonzero(counts[:room + 1])
        have = have[have > 0]
        if len(have) and have[-1] == a and counts[a] < 2:
            have = have[:-1]
        if len(have) and (best is None or a + have[-1] > sum(best)):
            best = (a, int(have[-1]))
            if sum(best) == gap:
                break
    return best


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths of a bin, number of such bins)] for counts by length."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = []
    while True:
        longest = np.flatnonzero(counts)
        if not len(longest):
            return plan
        bin_ = [int(longest[-1])]
        counts[bin_[0]] -= 1
        gap = capacity - bin_[0]
        while gap and len(fits := np.flatnonzero(counts[:gap + 1])):
            bin_.append(int(fits[-1]))
            counts[bin_[-1]] -= 1
            gap -= bin_[-1]
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            two = _best_two(counts, gap + smallest)
            if two and sum(two) > smallest:
                counts[smallest] += 1
                bin_[-1:] = two
                counts[two[0]] -= 1
                counts[two[1]] -= 1
        kinds, need = np.unique(bin_, return_counts=True)
        more = int((counts[kinds] // need).min())
        counts[kinds] -= more * need
        plan.append((bin_, 1 + more))


def plan_table(patterns: list[tuple[list[int], int]], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first number, first bin, step, offset) of the runs of pieces that
    take one place in one pattern; runs are ordered by first number."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            runs.setdefault(length, []).append((used.get(length, 0), base, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        base += times
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with doc_id, piece, start, length; durable) with sequence_id and
    offset. Other columns of the pieces are kept."""
    histogram = {r["length"]: r["n"] for r in  # at most ``capacity`` rows
                 pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = plan_table(plan_patterns(histogram, capacity), capacity)
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets(pieces.sparkSession)))
    ranked = rank_within(pieces, "length", ["doc_id", "piece", "start"], salt, "_number")

    def look_up(batches):
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "_number"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                mine = length == k
                first, base, offset = where[int(k)]
                run = np.searchsorted(first, number[mine], side="right") - 1
                seq[mine] = base[run] + number[mine] - first[run]
                off[mine] = offset[run]
            keep = [n for n in batch.schema.names if n != "_number"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(seq), pa.array(off)],
                                             names=[*keep, "sequence_id", "offset"])
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, "_number").mapInArrow(look_up, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Token sequences from packed pieces that carry ``ids``: one row per
    sequence (at most ``capacity`` ids), the pieces in order of offset."""
    part = F.struct("offset", "doc_id", "piece", "start", "ids")
    return (packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
            .select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
                    F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"),
                                                            p["start"].alias("start"), p["offset"].alias("offset"))).alias("parts")))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(spark, docs: DataFrame, sf_dir: str | None = None, path: str | None = None) -> DataFrame:
    """Pieces of ``docs`` with their places (also the pipeline's last stage)."""
    return pack(durable(token_pieces(docs, path or tokenizer_path())))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))
