"""Byte-level BPE as a lazily determinised finite-state transducer.

A sequence of tokens is the BPE encoding of its bytes exactly if every two
neighbours, encoded together, come out as those two tokens again. That makes
the encoder a finite-state machine: a hypothesis is (last token, place in the
trie of tokens), a byte moves the place, and reaching a token that is a valid
neighbour of the last one completes it. All hypotheses of a text are run at
once; a set of them is one state of the determinised transducer, and its output
is the token that ends at the byte read. Tokens on which all hypotheses agree
are emitted; one that differs dies within the length of the longest token, so
only a bounded lookahead is held back. States, their transitions and the table
of neighbours are made when first needed, in tables of bounded size.

Decoding is a stream: ids move a UTF-8 state machine (bytes still awaited, and
the range of the next one); complete characters leave at once, so ids may be
fed in portions that cut characters. Transitions over whole tokens are also
made when first needed.

Defined results: null text counts as empty, an empty text has no tokens; texts
of any length are encoded whole; repeated rows give repeated results; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, ship, table
from .text_cuts import CutMemo

MAX_STATES = 300_000
MAX_PAIRS = 300_000
CACHE = 150_000
_NONE = -1  # no token before


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_ranks(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE by definition: merge the leftmost pair of least rank until none is left."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class MergeTransducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, max_pairs: int = MAX_PAIRS):
        self._ranks = ranks
        self._bytes = {i: b for b, i in ranks.items()}
        self._length = {i: len(b) for b, i in ranks.items()}
        self._child: dict[int, int] = {}   # place * 256 + byte -> place
        self._token: dict[int, int] = {}   # place -> token that ends there
        self._inner: set[int] = set()      # places that tokens go on from
        self._depth = [0]
        for data, token in ranks.items():
            at = 0
            for byte in data:
                step = at * 256 + byte
                if step not in self._child:
                    self._inner.add(at)
                    self._child[step] = len(self._depth)
                    self._depth.append(self._depth[at] + 1)
                at = self._child[step]
            self._token[at] = token
        self._max_states, self._max_pairs = max_states, max_pairs
        self._window = 4 * max(self._depth)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        """Forget all states but the start: one hypothesis, no token, at the root."""
        start = ((_NONE, 0),)
        self._ids = {start: 0}
        self._states = [start]
        self._next: dict[int, int] = {}    # state * 256 + byte -> state
        self._last = [_NONE]               # state -> token that ends at this byte

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens, encoded together, give the two."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= self._max_pairs:
                self._pairs.clear()
            both = self._bytes.get(left, b"") + self._bytes[right]
            if left != _NONE and both in self._ranks and self._neighbours(_NONE, self._ranks[both]):
                known = False  # the two make one token
            else:
                known = merge_ranks(both, self._ranks) == ([right] if left == _NONE else [left, right])
            self._pairs[left, right] = known
        return known

    def _step(self, state: int, byte: int) -> int:
        """Make the transition of ``state`` over ``byte``."""
        found, ends = [], _NONE
        for last, place in self._states[state]:
            to = self._child.get(place * 256 + byte)
            if to is None:
                continue
            if to in self._inner:
                found.append((last, to))
            token = self._token.get(to)
            if token is not None and self._neighbours(last, token):
                found.append((token, 0))  # the only one: the text up to here has one encoding
                ends = token
        found.sort()
        key = tuple(found)
        to = self._ids.get(key)
        if to is None:
            to = self._ids[key] = len(self._states)
            self._states.append(key)
            self._last.append(ends)
        self._next[state * 256 + byte] = to
        return to

    def _path(self, ends: list[int], stop: int) -> list[int]:
        """Tokens of the encoding of the first ``stop`` bytes behind ``ends``."""
        out = []
        while stop > 0:
            token = ends[stop - 1]
            out.append(token)
            stop -= self._length[token]
        out.reverse()
        return out

    def _agreed(self, state: int, ends: list[int]) -> list[int]:
        """The tokens that all hypotheses of ``state`` have in common. Each began
        where its place's depth says; the token at that point is its last one."""
        paths = [self._path(ends, len(ends) - self._depth[place]) for _, place in self._states[state]]
        return paths[0][:next((i for i, column in enumerate(zip(*paths)) if len(set(column)) > 1), min(map(len, paths)))]

    def encode(self, data: bytes) -> list[int]:
        if len(self._states) > self._max_states:
            self._clear()
        out: list[int] = []
        ends: list[int] = []
        state, moves, last = 0, self._next, self._last
        if len(data) <= self._window:  # as good as every match: nothing to settle on the way
            ends = [0] * len(data)
            for i, byte in enumerate(data):
                try:
                    state = moves[state * 256 + byte]
                except KeyError:
                    state = self._step(state, byte)
                ends[i] = last[state]
            return self._path(ends, len(ends))
        for byte in data:
            to = moves.get(state * 256 + byte)
            state = self._step(state, byte) if to is None else to
            ends.append(last[state])
            if len(ends) > self._window:  # emit what is settled; only the lookahead is held
                settled = self._agreed(state, ends)
                out += settled
                del ends[:sum(map(self._length.__getitem__, settled))]
        return out + self._path(ends, len(ends))


# ------------------------------------------------------------------ decoding
def _utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """(bytes awaited, least, greatest next byte) after ``byte``; None: not UTF-8."""
    awaited, low, high = state
    if awaited:
        return (awaited - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return 0, 0x80, 0xBF
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:  # no overlong forms, no surrogates
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:  # no overlong forms, nothing above U+10FFFF
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


class StreamDecoder:
    """Characters of a stream of ids, as soon as their bytes are complete. Bytes
    that are not UTF-8 become U+FFFD, one for each maximal wrong start."""

    _ground = (0, 0x80, 0xBF)

    def __init__(self, tokens: dict[int, bytes]):
        self._tokens = tokens
        # Characters of tokens that start and end between characters; None: take the long way.
        self._whole: dict[int, str | None] = {}
        self.reset()

    def reset(self) -> None:
        self._state, self._held = self._ground, bytearray()

    def _feed_byte(self, byte: int, out: list[str]) -> None:
        after = _utf8_step(self._state, byte)
        if after is None:
            if self._held:  # the start was wrong; the byte may start anew
                out.append("�")
                self.reset()
                self._feed_byte(byte, out)
            else:
                out.append("�")
            return
        self._held.append(byte)
        self._state = after
        if not after[0]:
            out.append(self._held.decode())
            self.reset()

    def _learn(self, token: int) -> str | None:
        state = self._ground
        for byte in self._tokens[token]:
            state = _utf8_step(state, byte)
            if state is None:
                break
        self._whole[token] = self._tokens[token].decode() if state == self._ground else None
        return self._whole[token]

    def feed(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        whole = self._whole
        for token in ids:
            chars = whole[token] if token in whole else self._learn(token)
            if chars is not None and not self._held:
                out.append(chars)
            else:
                for byte in self._tokens[token]:
                    self._feed_byte(byte, out)
        return "".join(out)

    def finish(self) -> str:
        left = "�" if self._held else ""
        self.reset()
        return left


# ------------------------------------------------------------------- operator
class Codec:
    """Encoder and decoder of whole texts; remembers the ids of distinct cuts."""

    def __init__(self, ranks_path: str, pattern: str, cache: int = CACHE):
        import regex
        ranks = read_ranks(ranks_path)
        self._split = regex.compile(pattern)
        self._machine = MergeTransducer(ranks)
        self._decoder = StreamDecoder({i: b for b, i in ranks.items()})
        self._memo = CutMemo(self._learn, cache)

    def _learn(self, parts: list[str]) -> list[tuple]:
        """Ids, decimal ids and decoded characters of each cut. Cuts part between
        characters, so each decodes on its own; added values lie side by side."""
        found = (tuple(self.encode_part(p)) for p in parts)
        return [(ids, " ".join(map(str, ids)), self.decode(ids)) for ids in found]

    def encode_part(self, text: str) -> list[int]:
        """Ids of a text, each match of the pattern on its own."""
        out: list[int] = []
        for match in self._split.findall(text):
            out += self._machine.encode(match.encode())
        return out

    def coded(self, texts: list[str]) -> Iterator[tuple[list[tuple], str, str]]:
        """Of each text: ids by cuts, all ids in decimal joined by a space, and the
        characters that the ids decode to."""
        for parts in self._memo.of(texts):
            flat = list(chain.from_iterable(parts))
            yield flat[::3], " ".join(flat[1::3]), "".join(flat[2::3])

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for ids, _, _ in self.coded(texts):
            yield list(chain.from_iterable(ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self._decoder.feed(ids) + self._decoder.finish()


@kept
def _codec(ranks_path: str, pattern: str) -> Codec:
    """A worker process keeps its codec, and so its tables, from task to task."""
    return Codec(ranks_path, pattern)


def codec_rows(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded] of every text."""
    ship(docs.sparkSession)

    def run(batches):
        codec = _codec(ranks_path, pattern)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), batch.column("text")
            for lo in range(0, len(texts), 256):
                rows = []
                for ids, digits, back in codec.coded([t or "" for t in texts.slice(lo, 256).to_pylist()]):
                    rows.append((digits.count(" ") + 1 if digits else 0, hashlib.sha256(digits.encode()).hexdigest(),
                                 hashlib.sha256(back.encode()).hexdigest(),
                                 *((list(chain.from_iterable(ids)), back) if with_ids else ())))
                types = [pa.int64(), pa.string(), pa.string(), *((pa.list_(pa.int32()), pa.string()) if with_ids else ())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if with_ids else ())]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, 256), *columns], names=["doc_id", *names])
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, schema + (", ids array<int>, decoded string" if with_ids else ""))


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return codec_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
