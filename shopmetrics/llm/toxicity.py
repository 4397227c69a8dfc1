"""Toxicity: a linear-chain CRF tags toxic spans; forward-backward marginals
give document scores and the offending offsets.

Learning takes a bounded sample of labelled rows (``SAMPLE_TOXIC`` and
``SAMPLE_CLEAN`` documents of at most ``SAMPLE_CHARS`` characters, whole texts,
the least by a hash of doc_id; so at most about 30 MB whatever the corpus).
Document labels become token labels: in a toxic document a token is tagged 1 if
its letters or a prefix of them occur in so many more toxic than clean documents
that chance is ruled out (log-likelihood ratio). The CRF is fitted to these
tags, and a logistic curve maps a document's largest marginal to its score.
Scoring covers every row and whole texts, in the tasks, by a table of feature
weights whose size the sample bounds.

Defined results
- null, empty and blank-only texts have no token; they get the score of a
  document without any evidence;
- rows that repeat are scored each on their own, equal texts alike;
- a doc_id with several labels counts as toxic if any says so; null labels are
  left out; with no toxic or no clean label there is nothing to learn and every
  score is 0;
- labels, lang, source and doc_id are no inputs of a score; extra columns are
  not read; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import drop_kept, ship, table, text_or_empty

SAMPLE_TOXIC = 1_000
SAMPLE_CLEAN = 3_000
SAMPLE_CHARS = 6_000
THRESHOLD = 0.3
EVIDENCE = 8.0      # nats a feature needs to tag a token
PRECISION = 0.9      # share of toxic documents among those that hold it
TOKENS_KNOWN = 300_000
_LIMIT = 12.0        # log-odds beyond which marginals are not told apart


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    trans: np.ndarray
    start: np.ndarray
    curve: tuple[float, float]  # intercept and slope over the largest marginal's log-odds

    def emission(self, token: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in crf.token_features(token))


def _log_odds(p: np.ndarray) -> np.ndarray:
    return np.clip(np.log(np.maximum(p, 1e-300)) - np.log(np.maximum(1 - p, 1e-300)), -_LIMIT, _LIMIT)


class _Emissions(dict):
    def __init__(self, model: Model):
        super().__init__()
        self._model = model

    def __missing__(self, token: str) -> float:
        if len(self) > TOKENS_KNOWN:
            self.clear()
        value = self[token] = self._model.emission(token)
        return value


def tag_texts(model: Model, texts: list[str], known: dict[str, float]) -> list[tuple[float, list[dict]]]:
    """(score, spans) of each text; spans join neighbouring tokens tagged 1."""
    tokens = [t.split() for t in texts]
    lengths = np.array([len(t) for t in tokens], np.int64)
    emission = np.array([known[w] for t in tokens for w in t], dtype=float)
    p, _, _ = crf.Chains(lengths).marginals(emission, model.trans, model.start)
    most = np.full(len(texts), 0.0)
    some = lengths > 0
    if some.any():
        most[some] = np.maximum.reduceat(p, (np.cumsum(lengths) - lengths)[some])
    scores = crf._softmax2(model.curve[0] + model.curve[1] * _log_odds(most))
    out, at = [], 0
    for text, n, score, top in zip(texts, lengths, scores, most):
        spans: list[dict] = []
        if top >= 0.5:
            for place, m in zip(p[at:at + n], crf.TOKEN.finditer(text)):
                if place >= 0.5:
                    if spans and spans[-1]["next"] == m.start():
                        spans[-1].update(end=m.end(), marginal=max(spans[-1]["marginal"], float(place)))
                    else:
                        spans.append({"start": m.start(), "end": m.end(), "marginal": float(place)})
                    spans[-1]["next"] = m.end() + 1
            for s in spans:
                del s["next"]
        out.append((float(score), spans))
        at += n
    return out


# ------------------------------------------------------------------- learning
def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one number (Newton's method, light ridge)."""
    design = np.stack([np.ones_like(x), x / _LIMIT], 1)
    beta = np.zeros(2)
    ridge = np.diag([1e-3, 1e-1])
    for _ in range(50):
        mu = crf._softmax2(design @ beta)
        g = design.T @ (weight * (y - mu)) - ridge @ beta
        h = (design * (weight * mu * (1 - mu))[:, None]).T @ design + ridge
        beta = beta + np.linalg.solve(h, g)
    return float(beta[0]), float(max(beta[1], 0.0) / _LIMIT)


def _draws(tokens: np.ndarray, lengths: np.ndarray, rounds: int) -> np.ndarray:
    """For each document and round the least hash of its distinct tokens: near
    copies mostly draw the same."""
    out = np.zeros((rounds, len(lengths)), np.uint64)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    for k in range(rounds):
        h = (tokens.astype(np.uint64) + np.uint64(1 + k * 0x1000000)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[k, lengths > 0] = np.minimum.reduceat(h ^ (h >> np.uint64(32)), starts)
    return out


def _telling(n0: np.ndarray, f1: np.ndarray, d1: np.ndarray, draws: np.ndarray, base: float) -> np.ndarray:
    """Which features tell toxic from clean documents. ``n0`` counts the clean ones
    that hold each feature; ``f1`` and ``d1`` list each feature of each toxic one.
    Toxic documents that draw the same count once, by the round that leaves
    fewest, so a word that only near copies of one document share has no support."""
    n1 = np.bincount(f1, minlength=len(n0))
    for draw in draws:
        _, kind = np.unique(draw, return_inverse=True)
        once = np.unique(f1.astype(np.int64) * (kind.max() + 1) + kind[d1]) // (kind.max() + 1)
        n1 = np.minimum(n1, np.bincount(once, minlength=len(n0)))
    with np.errstate(divide="ignore", invalid="ignore"):
        share = n1 / (n0 + n1)
        gain = n1 * np.log(share / base) + np.where(n0 > 0, n0 * np.log((1 - share) / (1 - base)), 0.0)
    return (n1 > 0) & (share >= PRECISION) & (gain >= EVIDENCE)


def learn(texts: list[str], toxic: list[int], toxic_share: float) -> Model:
    """Fit a model to whole texts and their labels; ``toxic_share`` is the share of
    toxic documents among all labelled ones, which the sample need not have."""
    number: dict[str, int] = {}
    token_type = array("i")
    lengths = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = [number.setdefault(w, len(number)) for w in text.split()]
        token_type.extend(own)
        lengths[i] = len(own)
    token_type = np.frombuffer(token_type, np.int32) if len(token_type) else np.empty(0, np.int32)
    y = np.array(toxic, np.int64)
    index: dict[str, int] = {}
    feature, sizes = array("i"), np.zeros(len(number), np.int64)
    for k, token in enumerate(number):
        fs = crf.token_features(token)
        feature.extend([index.setdefault(f, len(index)) for f in fs])
        sizes[k] = len(fs)
    feature = np.frombuffer(feature, np.int32) if len(feature) else np.empty(0, np.int32)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    n_types = len(number)
    del number, texts  # what is left works on numbers
    # Documents that hold each feature: counts of the clean, places of the toxic.
    first, starts = np.cumsum(sizes) - sizes, np.cumsum(lengths) - lengths
    n0, f1, d1 = np.zeros(len(index), np.int64), [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for i in range(len(lengths)):
        kinds = np.unique(token_type[starts[i]:starts[i] + lengths[i]])
        held = np.unique(np.concatenate([feature[first[k]:first[k] + sizes[k]] for k in kinds])) if len(kinds) else f1[0]
        if y[i]:
            f1.append(held)
            d1.append(np.full(len(held), i))
        else:
            n0[held] += 1
    f1, d1 = np.concatenate(f1), np.concatenate(d1)
    telling = _telling(n0, f1, d1, _draws(token_type, lengths, 6), y.mean())
    lexical = np.fromiter((f[:2] in ("w=", "p=") for f in index), bool, len(index))
    marked = np.zeros(n_types, bool)
    marked[owner[(telling & lexical)[feature]]] = True
    tags = (marked[token_type] & np.repeat(y == 1, lengths)).astype(np.int64)
    often = n0 + np.bincount(f1, minlength=len(index)) > 1
    renumber = np.cumsum(often, dtype=np.int32) - 1
    index = {f: int(renumber[i]) for f, i in index.items() if often[i]}
    use = often[feature]
    feature, owner = renumber[feature[use]], owner[use]
    del f1, d1, n0, use, telling, lexical, marked, renumber
    w, trans, start = crf.fit(feature, owner, len(index), n_types, token_type, tags, lengths)
    del tags
    emission = crf.by_number(owner, w, feature, n_types)[token_type]
    weights = {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}
    p, _, _ = crf.Chains(lengths).marginals(emission, trans, start)
    most = np.zeros(len(lengths))
    some = lengths > 0
    if some.any():
        most[some] = np.maximum.reduceat(p, (np.cumsum(lengths) - lengths)[some])
    base = y.mean()
    weight = np.where(y == 1, toxic_share / base, (1 - toxic_share) / (1 - base))
    return Model(weights, trans, start, _fit_curve(_log_odds(most), y.astype(float), weight))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit a model to a bounded sample of the labelled rows that are not held out."""
    spark = docs.sparkSession
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    short = docs.select("doc_id").where(F.length(text_or_empty("text")) <= SAMPLE_CHARS).distinct()
    eligible = known.join(short, "doc_id").withColumn("h", F.xxhash64("doc_id"))
    picked = [(r["doc_id"], r["toxic"]) for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))
              for r in eligible.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(most).collect()]
    chosen = F.broadcast(spark.createDataFrame(picked, "doc_id long, toxic int"))  # the sample's bound
    sample = (docs.select("doc_id", text_or_empty("text").alias("text")).where(F.length("text") <= SAMPLE_CHARS)
              .join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")))
    share = n[1] / (n[0] + n[1])
    ship(spark)

    def fit(batches):
        drop_kept()  # the tables of other stages' tasks
        rows = sorted((r["doc_id"], r["text"], r["toxic"]) for b in batches for r in b.to_pylist())
        if len({r[2] for r in rows}) == 2:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn([r[1] for r in rows], [r[2] for r in rows], share))], pa.binary())], names=["model"])
    # The sample is bounded, so one task can hold it; the driver gets the weights.
    found = sample.repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, score and spans (start, end, marginal; code points) of every row."""
    schema = "doc_id long, score double, spans array<struct<start:int,end:int,marginal:double>>"
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])
    ship(docs.sparkSession)

    def run(batches):
        known = _Emissions(model) if model else None
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for lo in range(0, len(ids), 2048):
                part = [t or "" for t in texts.slice(lo, 2048).to_pylist()]
                found = tag_texts(model, part, known) if model else [(0.0, [])] * len(part)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, 2048), pa.array([s for s, _ in found], pa.float64()), pa.array([x for _, x in found], pa.list_(span))],
                    names=["doc_id", "score", "spans"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows whose text scores ``THRESHOLD`` or more (pipeline
    stage). The score is computed beside the row, so no join is needed."""
    model = train(docs, table(spark, sf_dir, "labels"))
    schema = docs.schema
    ship(spark)
    if model is None:
        return docs

    def run(batches):
        known = _Emissions(model)
        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, len(texts), 2048):
                found = tag_texts(model, [t or "" for t in texts.slice(lo, 2048).to_pylist()], known)
                yield batch.slice(lo, 2048).filter(pa.array([s < THRESHOLD for s, _ in found], pa.bool_()))
    return docs.mapInArrow(run, schema)
