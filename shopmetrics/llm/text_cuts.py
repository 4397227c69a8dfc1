"""Cutting texts where byte-level BPE never joins characters.

The split pattern of the byte-level vocabularies starts a new match at every
space or line feed that has a non-blank on both sides. Cutting there first lets
a worker remember the ids of each distinct cut; the ids of the cuts, one after
the other, are those of the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import compress
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Words hold no space, so a leading one can mark a key that stands for itself.
_PLAIN = " "


def keys(text: str) -> list[str]:
    """Keys of the cuts of ``text`` in order; ``plain`` gives a key's characters.

    Cutting at each blank is right unless blanks touch each other or an end;
    ``settled`` tells, and ``careful_keys`` then looks at each place."""
    if not text:
        return []
    words = text.replace("\n", " \n").split(" ")
    words[0] = _PLAIN + words[0]
    return words


def settled(key: str) -> bool:
    inner = key[1:] if key[:1] in (_PLAIN, "\n") else key
    return inner != "" and inner == inner.strip()


def careful_keys(text: str) -> list[str]:
    return [_PLAIN + part for part in _SAFE.split(text)]


def plain(key: str) -> str:
    if key[:1] == _PLAIN:
        return key[1:]
    return key if key[:1] == "\n" else " " + key


_MARKS = ",.;:!?"


class CutMemo:
    """What ``learn`` gives for each distinct cut, as values that can be added.
    Up to twice ``size`` cuts are remembered: when the young half is full it
    becomes the old one, whose entries in use move over to the new young half."""

    def __init__(self, learn: Callable[[list[str]], list[Any]], size: int):
        self._learn, self._size = learn, size
        self._young: dict[str, Any] = {}
        self._old: dict[str, Any] = {}

    def _fill(self, wanted: set[str]) -> None:
        """Remember the values of ``wanted``, none of which is in the young half.
        Closing marks that stand right after a letter are learnt on their own, as
        the split pattern ends a match between a letter and a mark."""
        young, old = self._young, self._old
        parts, marked = set(), []
        for k in wanted:
            if k in old:
                young[k] = old[k]
                continue
            stem = k.rstrip(_MARKS)
            if stem == k or not stem[-1:].isalpha():
                parts.add(k)
            else:
                marks = _PLAIN + k[len(stem):]
                parts.add(stem)
                parts.add(marks)
                marked.append((k, stem, marks))
        fresh = []
        for k in parts.difference(young):
            if k in old:
                young[k] = old[k]
            else:
                fresh.append(k)
        if fresh:
            young.update(zip(fresh, self._learn(list(map(plain, fresh)))))
        for k, stem, marks in marked:
            young[k] = young[stem] + young[marks]

    def of(self, texts: list[str]) -> Iterator[list[Any]]:
        """Values of the cuts of each text, in order."""
        if len(self._young) > self._size:
            self._old, self._young = self._young, {}
        cuts = [keys(t) for t in texts]
        wanted = set().union(*cuts).difference(self._young)
        # A word without a blank at an end, as most are, needs no closer look.
        odd = {k for k in wanted if (not k or k.strip() != k) and k not in self._old and not settled(k)}
        if odd:
            cuts = [careful_keys(t) if not odd.isdisjoint(c) else c for t, c in zip(texts, cuts)]
            wanted = set().union(*cuts).difference(self._young)
        self._fill(wanted)
        for cut in cuts:
            yield list(map(self._young.__getitem__, cut))

    def of_column(self, texts: pa.Array, learn_words: Callable[[list[str]], list[Any]]) -> tuple[list[Any], np.ndarray, np.ndarray]:
        """The same for a column without nulls, where each distinct cut of the column
        is looked up once: values, which of them the cuts of all texts have (in
        order), and the number of cuts of each text. ``learn_words`` takes keys
        without a blank but a line feed that they may begin with."""
        if len(self._young) > self._size:
            self._old, self._young = self._young, {}
        young, old = self._young, self._old
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = words.flatten().dictionary_encode()
        place, kinds = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        ends = words.offsets.to_numpy()[1:].astype(np.int64)
        sizes = np.diff(ends, prepend=0)
        heads = ends - sizes
        firsts = [_PLAIN + kinds[i] for i in place[heads]]
        place = place.astype(np.int32)  # a copy
        place[heads] = len(kinds) + np.arange(len(heads))
        values = list(map(young.get, kinds))
        odd = [i for i, v in enumerate(values) if v is None and ((k := kinds[i]).strip() != k or not k) and not settled(k)]
        odd += [len(kinds) + i for i, k in enumerate(firsts) if not settled(k)]
        kinds += firsts
        values += map(young.get, firsts)
        if odd:
            is_odd = np.zeros(len(kinds), bool)
            is_odd[odd] = True
            parts = np.split(place, ends[:-1])
            rows = np.flatnonzero(np.add.reduceat(is_odd[place], heads))  # no text is without a word
            for i, text in zip(rows, texts.take(pa.array(rows)).to_pylist()):
                own = careful_keys(text) if text else []
                parts[i] = np.arange(len(kinds), len(kinds) + len(own), dtype=np.int32)
                sizes[i] = len(own)
                kinds += own
                values += map(young.get, own)
            place = np.concatenate(parts)
            used = np.zeros(len(kinds), bool)
            used[place] = True
            place = (np.cumsum(used, dtype=np.int32) - 1)[place]
            kinds, values = list(compress(kinds, used)), list(compress(values, used))
        fresh, marked, learnt = [], [], {}
        for i in [i for i, v in enumerate(values) if v is None]:
            k = kinds[i]
            value = old.get(k)
            if value is not None:
                young[k] = values[i] = value
                continue
            stem = k.rstrip(_MARKS)
            if stem == k or not stem[-1:].isalpha():
                fresh.append(i)
                learnt[k] = None
                continue
            marks = _PLAIN + k[len(stem):]  # on their own, as in _fill
            marked.append((i, stem, marks))
            for part in (stem, marks):
                if part not in young:
                    if part in old:
                        young[part] = old[part]
                    else:
                        learnt[part] = None
        single = [k for k in learnt if k[:1] != _PLAIN]
        other = [k for k in learnt if k[:1] == _PLAIN]
        young.update(zip(single, learn_words(single)))
        young.update(zip(other, self._learn(list(map(plain, other)))))
        for i in fresh:
            values[i] = young[kinds[i]]
        for i, stem, marks in marked:
            young[kinds[i]] = values[i] = young[stem] + young[marks]
        return values, place, sizes
