"""Small fixtures and brute-force versions for the training-data operators."""

from __future__ import annotations

import base64
import re
from collections import Counter, defaultdict

import public_tokenizers as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 997}{'.' if i % 11 == 0 else ''}" for i in range(30_000))
# Nulls, empty and blank texts, repeats, ties, a very long text.
ODD = [
    (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 4), (4, "one", "en", "b", 3),
    (5, "one", "en", "b", 3), (5, "one", "en", "b", 3), (6, "the same words here", "en", "b", 19),
    (7, "the  same\nwords here", "en", "b", 20), (None, "the same words here", "en", "b", 19), (8, "ONE", "fr", "c", 3),
    (9, LONG, "en", "c", len(LONG)), (10, LONG + " more", "en", "c", len(LONG) + 5), (11, "naïve café 漢字 😀 end", "fr", "c", 20),
]


def frame(spark, rows, extra: bool = True):
    """Documents, with extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("kept", "keep_id", "score", "slot", "shard", "spans", "label", "node", "value", "_rank", "_salt", "piece", "n"):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df


def save(spark, tmp_path, rows, labels=()):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def encoding():
    import tiktoken
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("reference", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def brute_components(docs: dict[int, str], width=2, percent=80):
    """{doc_id: (set size, component)} by comparing all pairs."""
    sets = {d: shingles(t, width) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in docs}


def groups(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out


def bag(text):
    words = (text or "").split()
    return Counter(zip(words, words[1:]) if len(words) > 1 else [(w, w) for w in words])
