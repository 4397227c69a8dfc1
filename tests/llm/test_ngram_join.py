"""N-gram Jaccard join and its tiles against brute force."""

import random

import numpy as np
import pytest

from shopmetrics.llm import ngram_join, tiles

from .helpers import LONG, ODD, frame, groups, shingles


def brute(rows, width=4, percent=85):
    """Sorted (doc_id, set size, component, links) over rows, by comparing all pairs."""
    sets = [shingles(t, width) for _, t, *_ in rows]
    named = [r[0] is not None for r in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and named[i] and named[j] and sets[i] and sets[j]
              and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(n)]
    label = list(range(n))
    while True:
        new = [min([label[i]] + [label[j] for j in links[i]]) for i in range(n)]
        if new == label:
            break
        label = new
    least = {c: min((r[0] for r, x in zip(rows, label) if x == c and r[0] is not None), default=None) for c in set(label)}
    return sorted(((r[0], len(s), least[c] if r[0] is not None else None, len(x)) for r, s, c, x in zip(rows, sets, label, links)), key=str)


def joined(spark, rows, **more):
    return sorted(map(tuple, ngram_join.ngram_components(frame(spark, rows), **more).collect()), key=str)


def near_rows(seed=4, group=150):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for size in (3, 4, 8, 20, 60, 150):
        for edits in (0, 1, 2, 4, 8):
            a = [rnd.choice(words) for _ in range(size)]
            b = list(a)
            for _ in range(edits):
                b[rnd.randrange(size)] = rnd.choice(words)
            texts += [" ".join(a), " ".join(b).upper()]
    base = [rnd.choice(words) for _ in range(120)]
    for _ in range(group):  # a large group in which only some are near each other
        copy = list(base)
        for _ in range(rnd.randint(0, 5)):
            copy[rnd.randrange(120)] = rnd.choice(words)
        texts.append(" ".join(copy[:rnd.choice([120, 118, 104, 90])]))
    texts += [" ".join(base)] * 40
    shared = " ".join(rnd.choice(words) for _ in range(12))
    texts += [shared + " " + " ".join(rnd.choice(words) for _ in range(10)) for _ in range(60)]
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("width, percent", [(4, 85), (2, 60)])
def test_against_all_pairs(spark, width, percent):
    rows = near_rows()
    assert joined(spark, rows, width=width, percent=percent) == brute(rows, width, percent)


def test_small_tiles_and_row_blocks(spark, monkeypatch):
    """Groups over many tiles, bands, row blocks and blocks of columns."""
    monkeypatch.setattr(tiles, "ROWS", 9)
    monkeypatch.setattr(ngram_join, "BLOCK_VALUES", 700)
    rows = near_rows(5, 120)
    assert joined(spark, rows) == brute(rows)


def test_chain_reaches_the_least(spark):
    words = [f"c{i}" for i in range(200)]
    rows = [(50 - k, " ".join(words[2 * k:2 * k + 60]), None, None, None) for k in range(40)]
    assert joined(spark, rows) == brute(rows)
    assert {c for *_, c, _ in joined(spark, rows)} == {11}


def test_odd_rows(spark):
    long_pair = [(30, LONG.replace("word1 ", "changed "), "en", "c", 0)]
    rows = ODD + long_pair + [(5, "another text under the same id", "en", "b", 0), (40, "another text under the same id", "en", "b", 0)]
    assert joined(spark, rows) == brute(rows)
    by = groups((r[0], r) for r in joined(spark, rows))
    assert by[30][0][2] == 9 and by[8][0][2] == 4 and by[None][0][2:] == (None, 0)
    assert joined(spark, []) == []


def test_linked_by_columns():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 4000, rnd.integers(1, 3000))) for _ in range(30)] + [np.arange(9000), np.arange(8000), np.arange(40)]
    for percent in (10, 50, 85):
        want = np.array([[100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) for b in sets] for a in sets])
        np.fill_diagonal(want, False)
        assert (tiles.linked(sets, None, percent) == want).all()
        assert (tiles.linked(sets[:11], sets[11:], percent) == want[:11, 11:]).all()
