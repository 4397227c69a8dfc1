"""Lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from shopmetrics.llm import lexical_search as h

from .helpers import ODD, frame

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    big_n, big_l = len(counts), sum(n for *_, n in counts)
    df = Counter(x for _, c, _ in counts for x in c)
    out = []
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    for item, query in wanted.items():
        scored = []
        for d, c, n in counts:
            m = 10 + (90 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[x] + 1))) * ((10 ** 9 * c[x]) // (1000 * c[x] + 8 * m)) for x in query if x in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, tmp_path, docs, items, k=10):
    path = f"{tmp_path}/index"
    h.build_index(frame(spark, [(d, t, None, None, None) for d, t in docs])).write.parquet(path)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    return sorted(map(tuple, h.search(spark.read.parquet(path), asked, k).collect()), key=str)


def test_codes_round_trip():
    rnd = np.random.default_rng(0)
    x = np.r_[0, 1, 127, 128, 16383, 16384, rnd.integers(0, 1 << 40, 500)]
    code, ends = h.vbyte(x)
    assert (h.unvbyte(code) == x).all() and ends[-1] == len(code)


def corpus(seed, n, vocabulary=300):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Ñandú", "漢字", "x9"]
    heavy = [1 / (i + 1) for i in range(len(words))]
    docs = [(i * 3 % 997, rnd.choice([" ", ", ", "-"]).join(rnd.choices(words, heavy, k=rnd.choice([1, 5, 40, 400])))) for i in range(n)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 30])))) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("shard_docs, k", [(16_384, 10), (300, 3), (7, 10)])
def test_search_against_brute_force(spark, tmp_path, monkeypatch, shard_docs, k):
    docs, items = corpus(shard_docs, 900)
    monkeypatch.setattr(h, "ITEM_BLOCK", 16)
    index = f"{tmp_path}/index"
    monkeypatch.setattr(h, "SHARD_DOCS", shard_docs)
    h.build_index(frame(spark, [(d, t, None, None, None) for d, t in docs])).write.parquet(index)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, h.search(spark.read.parquet(index), asked, k).collect()), key=str)
    assert got == brute(docs, items, k)


def test_block_maxima_spare_blocks():
    """The first 128 documents hold both terms; later blocks of the common list stay packed."""
    n_docs = 4000
    lengths = np.full(n_docs, 50, np.int64)
    codes = np.concatenate([np.r_[np.zeros(3 if i < 128 else 1), np.full(1 if i < 128 else 0, 1), 2 + np.arange(46 if i < 128 else 49)] for i in range(n_docs)]).astype(np.int32)
    rows = h.shard_rows(0, list(range(n_docs)), lengths, codes, [b"common", b"rare"] + [b"f%d" % i for i in range(49)]).to_pylist()

    def of(term, weight):
        return h._List(next(r for r in rows if r["term"] == term), weight, lambda n: n, lengths)
    common, rare = of("common", 10), of("rare", 3000)
    docs, scores = h.best_of_shard([common, rare], n_docs, 10)
    assert docs.max() < 128 and common.all is None and len(common.open) == 1 and len(common.lasts) == 32
    assert len(set(scores.tolist())) == 1 and len(docs) == 128


def test_odd_rows_and_empty_tables(spark, tmp_path):
    docs = [(d, t) for d, t, *_ in ODD] + [(20, "same words"), (20, "same words"), (21, "!!! ---"), (22, "SAME wörds words")]
    items = [(1, "the same words"), (1, "café 漢字"), (None, "one ONE one"), (None, "words"), (2, ""), (3, None), (4, "absent"), (5, "word13 word14 more end")]
    assert found(spark, tmp_path / "a", docs, items) == brute(docs, items)
    assert found(spark, tmp_path / "b", [], items) == []
    assert found(spark, tmp_path / "c", docs, []) == []


def test_hot_term_ties_and_query(spark, tmp_path):
    docs = [(i, "hot " * (1 + i % 2) + f"own{i}") for i in range(1500)]
    items = [(0, "hot"), (7, "hot own33 own1200")]
    frame(spark, [(d, t, None, None, None) for d, t in docs]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, h.op11_lexical_search(spark, str(tmp_path)).collect()), key=str) == brute(docs, items)
