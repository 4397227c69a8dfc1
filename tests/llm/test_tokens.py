"""Packing, token counts, byte-level BPE, sharding."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from pyspark.sql import functions as F

from shopmetrics.llm import byte_bpe, packing, sharding, text_cuts, token_counts
from shopmetrics.llm.common import drop_kept, durable

from .helpers import ODD, encoding, frame, groups, save


# --------------------------------------------------------------------- packing
def check_packing(rows, docs, capacity=1024):
    bins, pieces = groups((r.sequence_id, r) for r in rows), groups(((r.doc_id), r) for r in rows)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    want = []
    for ids in docs:
        first = len(ids) % capacity or capacity
        start, stop = 0, first
        while start < len(ids):
            part = ids[start:stop]
            want.append((start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
            start, stop = stop, stop + capacity
    assert sorted((r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    return len(bins), sum(map(len, docs)), pieces


def test_packing_query(spark, tmp_path):
    rows = ODD + [(1000 + i, "copy copy " * (i % 3 * 90), "en", "hot", 0) for i in range(200)]
    got = packing.op1_best_fit_packing(spark, save(spark, tmp_path, rows)).collect()
    enc = encoding()
    bins, total, _ = check_packing(got, [enc.encode_ordinary(t or "") + [2] for _, t, *_ in rows])
    assert bins <= 1.05 * total / 1024 + 1
    assert packing.op1_best_fit_packing(spark, save(spark, tmp_path / "e", [])).count() == 0


def test_special_strings_as_the_library_has_them():
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "plain text, here.", "<|endoftext|>", "", "x<|endoftext|>y <|endoftext", "<|endof text|> z\n<|endoftext|>\n"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Encoder(path).encode(texts)] == want


def test_plan_beats_or_meets_first_fit_decreasing():
    rnd = random.Random(2)
    for trial in range(20):
        top = rnd.choice([40, 100])
        lengths = [rnd.randint(1, top) for _ in range(rnd.choice([5, 80, 400]))]
        hist = {k: lengths.count(k) for k in set(lengths)}
        plan = packing.plan_patterns(hist, 100)
        used = {}
        for bin_, times in plan:
            assert sum(bin_) <= 100 and times > 0
            for k in bin_:
                used[k] = used.get(k, 0) + times
        assert used == hist
        ffd = []
        for k in sorted(lengths, reverse=True):
            for i, room in enumerate(ffd):
                if room >= k:
                    ffd[i] -= k
                    break
            else:
                ffd.append(100 - k)
        assert sum(t for _, t in plan) <= len(ffd) + 1


def test_two_smaller_replace_the_smallest():
    # 60 + 30 leaves 10; 22 and 18 fill the gap of 40 that 30 leaves behind.
    assert packing.plan_patterns({60: 1, 30: 1, 22: 1, 18: 1}, 100)[0][0] == [60, 22, 18]


def test_ranks_are_dense(spark):
    df = durable(spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 3 * 0 + 7).alias("length"), F.lit(0).alias("piece"), F.lit(0).alias("start")))
    from shopmetrics.llm.common import rank_within
    got = rank_within(df, "length", ["doc_id"], F.pmod(F.xxhash64("doc_id"), F.lit(16)), "r").select("r").collect()
    assert sorted(r.r for r in got) == list(range(500))


def test_sequences_hold_the_ids(spark):
    docs = frame(spark, [(i, f"text {i} " * (i * 13 % 200), None, None, None) for i in range(1, 60)])
    packed = packing.pack(durable(packing.token_pieces(docs, P.path("byte_bpe_50k.json"), with_ids=True)))
    for r in packing.sequences(packed).collect():
        assert len(r.ids) <= 1024 and [p.offset for p in r.parts] == sorted(p.offset for p in r.parts)
    enc = encoding()
    total = sum(len(enc.encode_ordinary(f"text {i} " * (i * 13 % 200))) + 1 for i in range(1, 60))
    assert packing.sequences(packed).select(F.sum(F.size("ids"))).first()[0] == total


# -------------------------------------------------------------------------- BPE
PARTS = ["a", " ", "\n", "\t", "é", "'s", "the", "don't", " ", "1", "99", "漢", "😀", ".", "!!", "ing", " of", "  ", "\x1c", "-", "<|endoftext|>", "word,", "Ünï"]


def texts(n=400):
    rnd = random.Random(1)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_encoders_agree_with_the_libraries():
    enc, codec, whole = encoding(), byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, cache=50), packing.Encoder(P.path("byte_bpe_50k.json"), cache=50)
    sample = texts() + ["", "ab" * 3000, "theofand" * 400, "é" * 900]
    for lo in range(0, len(sample), 16):
        part = sample[lo:lo + 16]
        want = [enc.encode_ordinary(t) for t in part]
        assert list(codec.encode(part)) == want
        assert [np.frombuffer(b, "<u4").tolist() for b in whole.encode(part)] == want
        assert [codec.decode(ids) for ids in want] == part


def test_cuts_rebuild_the_text():
    for t in texts():
        assert "".join(map(text_cuts.plain, text_cuts.keys(t))) == t
        assert "".join(map(text_cuts.plain, text_cuts.careful_keys(t))) == t


def test_transducer_is_bpe_and_bounded():
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    machine = byte_bpe.MergeTransducer(ranks, max_states=200, max_pairs=100)
    rnd = random.Random(4)
    for _ in range(300):
        data = bytes(rnd.choice(b"theandofingr ") for _ in range(rnd.randint(0, 30))) + bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 5)))
        assert machine.encode(data) == byte_bpe.merge_ranks(data, ranks)
        assert len(machine._states) <= 200 + 40


def test_decoder_takes_any_portions():
    enc = encoding()
    tokens = {i: enc.decode_single_token_bytes(i) for i in range(50256)}
    dec = byte_bpe.StreamDecoder(tokens)
    rnd = random.Random(6)
    for t in texts(80):
        ids, out = enc.encode_ordinary(t), ""
        while ids:
            n = rnd.randint(1, 3)
            out, ids = out + dec.feed(ids[:n]), ids[n:]
        assert out + dec.finish() == t
    for _ in range(300):  # any ids: as the standard decoder replaces what is wrong
        ids = [rnd.randrange(256) for _ in range(rnd.randint(0, 8))]
        assert dec.feed(ids) + dec.finish() == b"".join(tokens[i] for i in ids).decode(errors="replace")


def test_bpe_query(spark, tmp_path):
    enc = encoding()
    got = byte_bpe.op7_byte_bpe(spark, save(spark, tmp_path, ODD)).collect()
    want = sorted((d or 0, len(ids := enc.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in ODD)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert byte_bpe.op7_byte_bpe(spark, save(spark, tmp_path / "e", [])).count() == 0


# ---------------------------------------------------------------- token counts
CHANGE = "doc_id long, tokenizer string, source string, lang string, n_tokens long, op string, seq int"


def test_ledger_against_replay(spark, tmp_path):
    rnd = random.Random(8)
    ledger, state, batches = token_counts.Ledger(spark, str(tmp_path / "ledger")), {}, []
    for b in range(4):
        rows = []
        for seq in range(60):
            key = (rnd.choice([None, *range(12)]), rnd.choice(["v1", "v2"]))
            rows.append((*key, rnd.choice([None, "s", "t"]), "en", rnd.choice([None, 0, 5, 9]), rnd.choice(["insert", "revise", "delete"]), seq))
        batches.append((f"batch-{b}", rows))
    for name, rows in [*batches, batches[1], batches[0]]:
        df = spark.createDataFrame(rows, CHANGE).withColumn("old", F.lit("x")).withColumn("live", F.lit("x"))
        again = name in {n for n, _ in batches[:batches.index((name, rows))]} or (name, rows) in state.get("done", [])
        assert ledger.apply(name, df) is (not again)
        if not again:
            for key in {r[:2] for r in rows}:
                last = max((r for r in rows if r[:2] == key), key=lambda r: r[6])
                if last[5] == "delete":
                    state.pop(key, None)
                else:
                    state[key] = (last[2], last[3], last[4] or 0)
            state.setdefault("done", []).append((name, rows))
    want = {}
    for key, value in state.items():
        if key != "done":
            cell = want.setdefault((value[0], value[1], key[1]), [0, 0])
            cell[0] += 1
            cell[1] += value[2]
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in ledger.totals().collect()}
    assert got == want


def test_half_written_batch_is_invisible(spark, tmp_path):
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    row = spark.createDataFrame([(1, "v", "s", "en", 5, "insert", 0)], CHANGE)
    ledger.apply("a", row)
    row.write.parquet(str(tmp_path / "ledger/batches/b-attempt/delta"))  # an attempt without its marker
    assert [tuple(r) for r in ledger.totals().collect()] == [("s", "en", "v", 1, 5)]
    assert ledger.apply("empty", row.where("false")) and ledger.totals().count() == 1


def test_counts_of_odd_texts(spark, tmp_path):
    native = {(r.doc_id, r.tokenizer): r.n_tokens for r in token_counts.native_counts(frame(spark, ODD)).collect()}
    assert native[(1, "words-1")] == native[(3, "words-1")] == 0 and native[(6, "words-1")] == 4
    bpe = {r.doc_id: r.n_tokens for r in token_counts.bpe_counts(frame(spark, ODD), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, "v").collect()}
    assert bpe[9] == len(encoding().encode_ordinary(dict((d, t) for d, t, *_ in ODD)[9])) and bpe[1] == 0
    assert token_counts.op6_token_counts(spark, save(spark, tmp_path, [])).count() == 0


# -------------------------------------------------------------------- sharding
def test_lookup_table_is_even_and_stable():
    names = sharding.shard_names(13)
    slots = sharding.lookup_table(names, 1009)
    shares = [slots.count(i) for i in range(13)]
    assert max(shares) - min(shares) <= 1 and sum(shares) == 1009
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(slots, fewer) if a != 12)
    assert moved < 0.15 * 1009  # mostly the slots of the shard that went change hands
    mixed = names[::-1]
    assert [mixed[i] for i in sharding.lookup_table(mixed, 1009)] == [names[i] for i in slots]


def test_permutation_by_definition():
    names, size = ["x", "y", "z"], 31
    orders = []
    for n in names:
        at, step = sharding._number("offset", n) % size, 1 + sharding._number("step", n) % (size - 1)
        orders.append([(at + j * step) % size for j in range(size)])
    slots = [None] * size
    while None in slots:
        for i, order in enumerate(orders):
            free = [s for s in order if slots[s] is None]
            if free:
                slots[free[0]] = i
    assert sharding.lookup_table(names, size) == slots


def test_placement(spark, tmp_path):
    path = save(spark, tmp_path, ODD)
    got = sharding.op8_sharding(spark, path).collect()
    slots = sharding.lookup_table(sharding.shard_names())
    assert len(got) == len(ODD)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE and r.shard == slots[r.slot]
    sharding.write_shards(frame(spark, ODD), "doc_id", sharding.shard_names(4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD)
    assert sharding.op8_sharding(spark, save(spark, tmp_path / "e", [])).count() == 0


def test_matches_around_the_lookahead_and_states_that_are_kept():
    """Matches that end before, at and behind the held window; the states of many words are made once."""
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    machine = byte_bpe.MergeTransducer(ranks)
    rnd = random.Random(7)
    for n in range(machine._window - 3, machine._window + 4):
        data = bytes(rnd.choice(b"theandofingr") for _ in range(n))
        assert machine.encode(data) == byte_bpe.merge_ranks(data, ranks)
    assert machine.encode(b"") == []
    words = ["".join(rnd.choices("etaoinshrdlucmfgyp", k=10)).encode() for _ in range(40_000)]
    first = [machine.encode(w) for w in words]
    machine._step = None  # no transition is left to make
    assert [machine.encode(w) for w in words] == first


def test_ordinary_cuts_need_no_closer_look(monkeypatch):
    looked = []
    monkeypatch.setattr(text_cuts, "settled", lambda k, of=text_cuts.settled: looked.append(k) or of(k))
    memo = text_cuts.CutMemo(lambda parts: [(p,) for p in parts], 4)
    texts = ["plain words, here.", "two  blanks", " a\tb \n", "end.", "plain words, here."]
    for _ in range(3):  # the young half becomes the old one on the way
        for text in texts:
            assert "".join("".join(p) for cut in memo.of([text]) for p in cut) == text
    assert looked and not {"words,", "here.", "blanks"} & set(looked)


def test_cuts_are_decoded_once():
    import public_tokenizers
    codec = byte_bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    fed = []
    feed = codec._decoder.feed
    codec._decoder.feed = lambda ids: fed.extend(ids) or feed(ids)
    texts = ["snow über Ёлка, 雪  \t🎿 x.", "", "again and again"] * 20
    for text, (ids, digits, back) in zip(texts, codec.coded(texts)):
        assert back == text
        assert digits == " ".join(str(i) for cut in ids for i in cut)
    once = len(fed)
    assert [list(i) for i in codec.encode(texts)] == [[int(d) for d in digits.split()] for _, digits, _ in codec.coded(texts)]
    assert len(fed) == once < sum(map(len, codec.encode(texts))) / 10


# -------------------------------------------------------------- columns of texts
def test_columns_of_texts_have_the_librarys_ids():
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    rows = texts(600) + ["", " ", "\n", "  a", "a  ", "\na", "a\n", "a \x1c b", "words, and words. and\nwords"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(rows, add_special_tokens=False)]
    for cache in (20, 10_000):
        enc, got = packing.Encoder(path, cache=cache), []
        for lo in range(0, len(rows), 37):
            flat, counts = enc.encode_column(pa.array(rows[lo:lo + 37]))
            got += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
        assert got == want
    assert enc.encode_column(pa.array([], pa.string()))[1].tolist() == []


def test_new_words_are_encoded_together():
    enc, seen = packing.Encoder(P.path("byte_bpe_50k.json")), []
    plainly = enc._ids
    enc._ids = lambda parts: seen.extend(parts) or plainly(parts)
    enc.encode_column(pa.array([" ".join(f"w{i}x{j}" for j in range(500)) for i in range(10)]))
    assert len(seen) <= 10 + 5_000 // packing.JOINED + 1  # the first words, and joined ones


def test_portions_by_size():
    got = list(packing.portions(pa.array(["a" * n for n in (3, 3, 3, 50, 1, 0, 9, 1)]), 7))
    assert got == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7), (7, 8)]


def test_kept_tables_are_dropped():
    first = packing._encoder(P.path("byte_bpe_50k.json"))
    assert packing._encoder(P.path("byte_bpe_50k.json")) is first
    drop_kept()
    assert packing._encoder(P.path("byte_bpe_50k.json")) is not first


def test_cuts_with_closing_marks_are_learnt_without_them_in_columns():
    learnt = []

    def learn(parts):
        learnt.extend(parts)
        return [f"<{p}>".encode() for p in parts]
    memo = text_cuts.CutMemo(learn, 100)

    def words(keys):
        return learn([text_cuts.plain(k) for k in keys])
    values, place, sizes = memo.of_column(pa.array(["ab cd. ef?!", "ab. cd ef 1. ..."]), words)
    assert [values[i] for i in place] == [b"<ab>", b"< cd><.>", b"< ef><?!>", b"<ab><.>", b"< cd>", b"< ef>", b"< 1.>", b"< ...>"]
    assert sizes.tolist() == [3, 5] and len(learnt) == len(set(learnt))  # " cd" once, with and without its mark


def test_a_whole_batch_is_one_portion():
    assert list(packing.portions(pa.array(["a" * 3_300] * 1_000))) == [(0, 1_000)]
