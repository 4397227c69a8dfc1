"""Toxicity, substring dedup, near-dedup and the pipeline."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from shopmetrics.llm import crf, near_dedup, substring_dedup, toxicity

from .helpers import LONG, ODD, brute_components, frame, groups, save, shingles


# ------------------------------------------------------------------------- CRF
def test_marginals_by_enumeration():
    rnd = np.random.default_rng(0)
    lengths = np.array([3, 0, 5, 1, 3])
    e, trans, start = rnd.normal(size=lengths.sum()), rnd.normal(size=(2, 2)), rnd.normal(size=2)
    p, _, _ = crf.Chains(lengths).marginals(e, trans, start)
    at = 0
    for n in lengths:
        weight = {}
        for tags in itertools.product((0, 1), repeat=int(n)):
            s = sum(e[at + i] * t for i, t in enumerate(tags)) + (start[tags[0]] if n else 0)
            weight[tags] = np.exp(s + sum(trans[a, b] for a, b in zip(tags, tags[1:])))
        for i in range(n):
            assert p[at + i] == pytest.approx(sum(w for t, w in weight.items() if t[i]) / sum(weight.values()))
        at += n


def corpus(n=400, seed=2):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                text.insert(rnd.randrange(len(text)), rnd.choice(["grumbolt", "Zwackig,", "zwackend", "plonker"]))
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark, tmp_path):
    rows, labels = corpus()
    odd = [(5000 + i, t, None, None, None) for i, (_, t, *_) in enumerate(ODD)] + [(6000, LONG + " grumbolt " + LONG, "en", "x", 0)]
    got = {r.doc_id: r for r in toxicity.op3_toxicity(spark, save(spark, tmp_path, rows + odd, labels + [(7, 1, None), (8, None, 1)])).collect()}
    assert len(got) == len(rows + odd)
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == y for i, y in held) >= 0.97 * len(held)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert got[5000].predicted == 0 and got[6000].predicted == 1
    text = LONG + " grumbolt " + LONG
    assert [text[s.start:s.end] for s in got[6000].spans] == ["grumbolt"]


def test_toxicity_without_labels(spark, tmp_path):
    got = toxicity.op3_toxicity(spark, save(spark, tmp_path, ODD)).collect()
    assert len(got) == len(ODD) and all(r.score == 0 and r.predicted == 0 for r in got)
    assert toxicity.op3_toxicity(spark, save(spark, tmp_path / "e", [])).count() == 0


# ------------------------------------------------------------------- substrings
PASSAGE = "First sentence of a shared passage here. Second one follows it closely! Third ends the passage now."


def test_substring_dedup(spark):
    rows = [(1, f"Own start one. {PASSAGE} Own end of the first.", "en", "a", 0),
            (2, f"Another beginning it is. {PASSAGE} A different end.", "en", "a", 0),
            (3, PASSAGE.replace(" ", "  ") + "\n", "en", "a", 0),
            (4, "Short. One. Short. One.", "en", "a", 0), (5, "Short. One. Short. One.", "en", "a", 0),
            (6, f"{PASSAGE}\n{PASSAGE}", "en", "a", 0)]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(frame(spark, rows + [(10 + (d or 90), *r) for d, *r in ODD])).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed == 0
    assert got[2].text == "Another beginning it is. A different end." and got[2].n_removed == 3
    assert got[3].text == "" and got[6].text == "" and got[3].chars_removed == len(rows[2][1])
    assert got[4].text == got[5].text == rows[3][1]  # spans of few words stay
    assert got[19].n_removed == 0 or got[20].n_removed > 0
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_substring_common_passage_and_repeated_rows(spark):
    rows = [(i, f"Head number {i} is mine alone. {PASSAGE} Tail number {i}.", "en", "hot", 0) for i in range(300)]
    got = substring_dedup.remove_repeats(frame(spark, rows + rows[:3])).collect()
    assert [r.doc_id for r in got if r.n_removed == 0] == [0, 0]  # both rows of the first document
    assert all(r.n_removed == 3 for r in got if r.doc_id) and len(got) == 303


def brute_passages(rows, width=50):
    """{(doc_id, text): text without the words of repeated windows}, no sentences."""
    docs = sorted({(d is None, d or 0, h, t) for d, h, t in rows})
    first, gone = {}, {}
    for k, (*_, t) in enumerate(docs):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        for at in range(len(words) - width + 1):
            doc, place = first.setdefault(tuple(words[at:at + width]), (k, at))
            if (doc, place) != (k, at):
                gone.setdefault(k, set()).update(range(max(at, place + width) if doc == k else at, at + width))
    out = {}
    for k, (unnamed, d, _, t) in enumerate(docs):
        parts = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t)
        lead = re.match(r"[\x20\x09-\x0D]*", t)[0]
        out[None if unnamed else d, t] = lead + "".join(w for i, w in enumerate(parts) if i not in gone.get(k, ()))
    return out


def test_substring_passages_cut_anywhere(spark):
    rnd = random.Random(8)
    words = [f"w{i}é" for i in range(5000)]

    def own(n):
        return [rnd.choice(words) for _ in range(n)]
    shared, texts = own(160), []
    for n in (49, 50, 51, 65, 160):  # without marks, at any place
        for _ in range(4):
            a = rnd.randrange(160 - n + 1)
            texts.append(own(rnd.randrange(90)) + shared[a:a + n] + own(rnd.randrange(90)))
    # Cut in the middle of sentences, one whole sentence between the cuts.
    marked = own(29) + ["end."] + own(14) + ["stop."] + own(30)
    texts += [own(7) + marked[5:60] + own(9), own(3) + marked[2:70] + own(4)]
    texts += [["x"] * 300, ["a", "b", "c"] * 70, own(20) + ["a", "b", "c"] * 18, own(55) * 3, own(49) * 2]  # repeats of itself
    base = own(200)
    texts += [base, base, base[:120] + ["changed"] + base[121:], own(40_000) + base[10:70]]
    joined = [rnd.choice([" ", "  ", "\t"]).join(t) for t in texts]
    rows = [(i, t, "en", "p", 0) for i, t in enumerate(joined)]
    rows += [(None, joined[0] + " more", "en", "p", 0), (3, joined[8], "en", "p", 0), rows[2], (900, " " + joined[4] + " ", "en", "p", 0)]
    df = frame(spark, rows)
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) as h").collect()}
    want = brute_passages([(d, hashes[t], t) for d, t, *_ in rows])
    got = substring_dedup.remove_passages(df).collect()
    before = sorted(((d, t) for d, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((d, want[d, t]) for d, t in before), key=str)
    assert sum(r.chars_removed for r in got) == sum(len(t) - len(want[d, t]) for d, t in before) > 0
    # By whole sentences none of the passages cut in their middle is found.
    assert all(r.n_removed == 0 for r in substring_dedup.remove_repeats(df).collect())
    assert substring_dedup.remove_passages(frame(spark, [])).count() == 0


# ------------------------------------------------------------------ near copies
def family(rnd, words, size, edits):
    base = [rnd.choice(words) for _ in range(size)]
    copy = list(base)
    for _ in range(edits):
        copy[rnd.randrange(size)] = rnd.choice(words)
    return base, copy


def near_rows(seed=4):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for size in (3, 8, 20, 30, 60, 150):
        for edits in (0, 1, 2, 4, 8):
            a, b = family(rnd, words, size, edits)
            texts += [" ".join(a), " ".join(b).upper()]
    base = [rnd.choice(words) for _ in range(120)]
    for _ in range(120):  # a large group in which not all copies are near each other
        copy = list(base)
        for _ in range(rnd.randint(0, 7)):
            copy[rnd.randrange(120)] = rnd.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 40
    shared = " ".join(rnd.choice(words) for _ in range(12))
    texts += [shared + " " + " ".join(rnd.choice(words) for _ in range(10)) for _ in range(60)]
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_components_against_all_pairs(spark, width):
    rows = near_rows()
    got = {r.doc_id: r for r in near_dedup.near_components(frame(spark, rows), width=width).collect()}
    want = brute_components({d: t for d, t, *_ in rows}, width)
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_near_components_odd_rows(spark):
    got = near_dedup.near_components(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = groups((r.doc_id, r) for r in got)
    assert all(by[d][0].n_shingles == 0 and by[d][0].component_id == d for d in (1, 2, 3))
    assert [r.component_id for r in by[5]] == [4, 4] and by[8][0].component_id == 4  # lowered
    assert by[7][0].component_id == 6 and by[10][0].component_id == 9
    assert by[None][0].component_id is None and by[None][0].kept
    assert near_dedup.near_components(frame(spark, [])).count() == 0


def test_near_chain_reaches_the_least(spark):
    words = [f"c{i}" for i in range(200)]
    rows = [(50 - k, " ".join(words[2 * k:2 * k + 60]), None, None, None) for k in range(40)]
    got = {r.component_id for r in near_dedup.near_components(frame(spark, rows)).collect()}
    assert got == {c for _, c in brute_components({d: t for d, t, *_ in rows}).values()}


def test_near_stage_keeps_other_texts_under_one_id(spark):
    text = " ".join(f"s{i}" for i in range(60))
    other = " ".join(f"o{i}" for i in range(60))
    rows = [(1, text, "en", "a", 0), (5, text + " x", "en", "a", 0), (5, other, "en", "a", 0),
            (2, "near " + other, "en", "a", 0), (7, text + " y", "en", "a", 0), (7, text + " z", "en", "a", 0), (None, text, "en", "a", 0), (8, None, "en", "a", 0)]
    docs = frame(spark, rows)
    for name in ("doc_id_", "text_hash", "label", "component_id", "digest", "_gone", "first"):
        docs = docs.withColumn(name, docs["lang"])
    got = near_dedup.drop_near_copies(spark, docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == sorted([(1, text), (2, "near " + other), (0, text), (8, "")])
    assert all(r.text_hash == "en" and r.kept == "x" for r in got.collect())


def test_near_rows_of_long_lists(spark, monkeypatch):
    """Lists and groups over many tiles."""
    monkeypatch.setattr(near_dedup.tiles, "ROWS", 8)
    rows = near_rows(6)
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(frame(spark, rows)).collect()}
    assert got == {d: c for d, (_, c) in brute_components({d: t for d, t, *_ in rows}).items()}


def test_union_sketch_estimates():
    rnd = np.random.default_rng(5)
    k, pool = 8, np.arange(30)
    sets = [np.sort(rnd.choice(pool, rnd.integers(1, 20), replace=False))[:k] for _ in range(40)]
    sketches = np.full((40, k), np.iinfo(np.int64).max)
    for i, s in enumerate(sets):
        sketches[i, :len(s)] = s
    a, b = map(np.array, zip(*itertools.combinations(range(40), 2)))
    want = [100 * len(set(sets[i]) & set(sets[j]) & set(u)) >= 40 * len(u)
            for i, j in zip(a, b) for u in [np.union1d(sets[i], sets[j])[:k]]]
    assert near_dedup.estimates(sketches, np.array([len(s) for s in sets]), a, b, k, 40).tolist() == want


# --------------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, tmp_path):
    rows, labels = corpus(200)
    rows += [(1000 + i, rows[i + 1][1], "en", "copy", 0) for i in range(0, 40, 4)]          # exact copies
    rows += [(2000, rows[2][1] + " tail", "en", "near", 0), (2001, "token = abcdefghijkl0123 " + rows[3][1] + " zz", "en", "secret", 0), (2002, None, None, None, None)]
    path = save(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    toxic = {d for d, _, y in labels if y}
    assert len(toxic & set(seen["toxicity"])) <= 2 and len(seen["toxicity"]) >= 158
    assert not any(1000 <= d < 2000 for d in seen["exact dedup"])
    texts = seen["exact dedup"]
    want = {d for d, (_, c) in brute_components(texts, 5).items() if c == d}
    assert set(seen["near dedup"]) == want
    assert set(seen["secret scans"]) == want
    assert all("abcdefghijkl0123" not in (t or "") for t in seen["secret scans"].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in packed} == want
    assert corpus_pipeline.run(spark, path).count() == len(packed)
    assert shingles("a b", 2)


def test_pipeline_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, save(spark, tmp_path, [])).count() == 0


def test_fit_holds_few_arrays_of_tokens():
    import tracemalloc
    rnd = np.random.default_rng(1)
    tokens, types, features = 200_000, 5_000, 2_000
    feature = rnd.integers(0, features, 8 * types).astype(np.int32)
    owner = np.repeat(np.arange(types, dtype=np.int32), 8)
    weight = rnd.random(features)
    assert np.array_equal(crf.by_number(owner, weight, feature, types), np.bincount(owner, weights=weight[feature], minlength=types))
    token_type, tags = rnd.integers(0, types, tokens).astype(np.int32), (rnd.random(tokens) < 0.1).astype(np.int64)
    tracemalloc.start()
    crf.fit(feature, owner, features, types, token_type, tags, np.full(400, 500), steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110 * tokens, peak / tokens
