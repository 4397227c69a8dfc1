"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

Terms are runs of two words, weighted by how often they occur in the text. For
each of ``samples`` draws a term k has its own r and c ~ Gamma(2, 1) and b ~
U(0, 1), derived from hashes of (k, draw). With weight S,

    t = floor(ln S / r + b),   ln y = r (t - b),   ln a = ln c - ln y - r,

and the term with the least a is the draw's sample (k, t). Two texts draw the
same sample with a probability equal to their generalised Jaccard similarity
sum(min S) / sum(max S). As a is a function of (k, t) alone, the least a itself
names the sample: a signature is one minimum of doubles per draw, which a hash
aggregation keeps in fixed-size buffers with map-side combine.

A text and its edited text share most terms: a term that occurs equally often in
both is drawn once for the two. The least a of n weights is exponential with
rate n, so all but a small share of the terms lie above a ceiling that the least
one exceeds in one of exp(SPREAD) draws only. Terms whose a a cheap lower bound
puts above it take no logarithms. Signatures are checked to end below their
ceiling, and so are exact; one that does not (about 1e-8 for all draws of 15
million texts) stops the query instead of giving a wrong row.

Plan: texts cross one shuffle, into buckets of neighbouring ids (cut at
approximate quantiles; the number of buckets follows the texts' bytes, within
once and eight times the session's shuffle width). The first row of each bucket is also sent to the bucket before it, the
very first one to the last, so every row finds its successor inside its bucket.
Counting terms and taking minima are grouped by the bucket first and need no
further shuffle; no group is larger than a text.

Defined results
- null text counts as empty; a text without words has the fingerprint of the
  empty set, which is like itself (1) and unlike all others (0); a single word
  is paired with itself;
- rows are ordered by doc_id (null first), then text; rows that repeat a doc_id
  are neighbours and each have their row; a single row is its own successor;
- equal texts have equal fingerprints; extra columns are not read; an empty
  table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets, table, text_or_empty

# The standard error of a likeness s is sqrt(s * (1 - s) / SAMPLES), 0.05 at 0.8.
SAMPLES = 64
SPREAD = 40.0  # exp(-40) = 4e-18 a draw; 2e9 draws in 15 million texts and edited texts
BLOCK = 32  # draws of one row; each is a long expression, which the driver plans once for all blocks
BUCKET = 2 << 20  # bytes of text
_EMPTY = -1e300  # in place of the least a of no terms
_ANY = 1e300  # a ceiling above every a
_NONE = float("inf")  # no term below the ceiling
_SHARED, _OWN, _EDITED = 2, 0, 1  # the texts that a term's weight is of
_FIRST = -(1 << 63)  # orders null ids before all others


# -------------------------------------------------------------------- samples
def _hash(draw: int, k: int) -> str:
    return f"xxhash64(term, _seed + {3 * draw + k})"


def _product(h: str) -> Column:
    """Product of two numbers in (0, 1) from the halves of a 64-bit hash. Written as
    SQL, as each call on a Column costs the driver time and memory."""
    return F.expr(f"(({h} & 4294967295) + 0.5D) * (shiftrightunsigned({h}, 32) + 0.5D) * {2.0 ** -64!r}D")


def numbers(draw: int) -> tuple[Column, Column, Column]:
    """x = exp(-r), p = exp(-c) and b of ``term`` in one draw of the block at ``_seed``."""
    return (_product(_hash(draw, 0)), _product(_hash(draw, 1)),
            F.expr(f"(({_hash(draw, 2)} & 4294967295) + 0.5D) * {2.0 ** -32!r}D"))


def log_a(x: Column, p: Column, b: Column, log_weight: Column) -> Column:
    """ln a of a term in one draw."""
    r = -F.log(x)
    t = F.floor(log_weight / r + b)
    return F.log(-F.log(p)) - r * (t.cast("double") - b) - r


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")


def _neighbours(words: Column) -> tuple[Column, Column]:
    """First and second words of the runs of two; a single word is paired with itself."""
    n = F.size(words)
    return F.when(n > 1, F.slice(words, F.lit(1), n - 1)).otherwise(words), F.when(n > 1, F.slice(words, F.lit(2), n - 1)).otherwise(words)


def term_rows(rows: DataFrame, words: str, keep: list[str]) -> DataFrame:
    """``keep`` and term: one row per run of two ``words`` (null for no words)."""
    a, b = _neighbours(F.col(words))
    return (rows.select(*keep, F.inline_outer(F.arrays_zip(a.alias("a"), b.alias("b"))))
            .select(*keep, F.when(F.col("a").isNotNull(), F.xxhash64("a", "b")).alias("term")))


def ceiling(pairs: Column, spread: float = SPREAD) -> Column:
    """What the least a of a text of so many pairs exceeds with a probability of
    exp(-spread) in a draw; ``_ANY`` where that would leave nothing out."""
    return F.when(pairs > spread, F.lit(float(spread)) / pairs).otherwise(F.lit(_ANY))


def may_be_below(x: Column, p: Column, b: Column, cut: Column) -> tuple[Column, Column]:
    """Two conditions, the cheaper first, that hold for each a below ``cut`` of a
    term of weight 1. With x = exp(-r) and p = exp(-c), a = c x ** (1 - b), where
    c >= 3 (1 - p p) / (1 + 4 p + p p) and x ** (1 - b) >= x / (1 - b + b x) >= x."""
    low, high = 3.0 * x * (1.0 - p * p), cut * (1.0 + p * (4.0 + p))
    return low < high, low < high * (1.0 - b + b * x)


def _least_a(draw: int) -> Column:
    """The least ln a of ``term`` and ``_seed`` rows with ``_lw`` (ln of the weight) that may be
    below ``_cut``."""
    x, p, b = numbers(draw)
    first, second = may_be_below(x, p, b, F.col("_cut"))
    # One condition inside the other, so that b is made only behind the first.
    return F.min(F.when(first, F.when(second, log_a(x, p, b, F.col("_lw")))))


def signatures(counted: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys``, signature (array of ``samples`` doubles, infinite where no term is
    below the ceiling) and _ceiling, from rows of term, its count _n and _ceiling,
    which is the same in all rows of a key. See :func:`settled`."""
    width = min(samples, BLOCK)
    seeds = F.array(*[F.lit(3 * at) for at in range(0, samples, width)])
    weighted = counted.select(
        *keys, "term", "_ceiling", F.when(F.col("term").isNotNull(), F.log(F.col("_n").cast("double"))).alias("_lw"),
        F.when(F.col("_n") == 1, F.col("_ceiling") * (1 + 1e-6)).otherwise(F.lit(_ANY)).alias("_cut"),  # a margin for rounding
        F.explode(seeds).alias("_seed"))
    blocks = weighted.groupBy(*keys, "_seed").agg(F.min("_ceiling").alias("_ceiling"), *[_least_a(d).alias(f"_m{d}") for d in range(width)])
    least = F.array(*[F.coalesce(f"_m{d}", F.lit(_NONE)) for d in range(width)])
    whole = F.flatten(F.transform(F.array_sort(F.collect_list("_block")), lambda b: b["least"]))
    return (blocks.select(*keys, "_ceiling", F.struct("_seed", least.alias("least")).alias("_block"))
            .groupBy(*keys).agg(F.min("_ceiling").alias("_ceiling"), F.slice(whole, 1, samples).alias("signature")))


def settled(signature: Column) -> Column:
    """``signature``, which must be below ``_ceiling`` in each draw (any is, where
    nothing was left out); no words have the signature of the empty set."""
    samples = F.transform(signature, lambda x: F.when(x == _NONE, _EMPTY).otherwise(x))
    sure = (F.col("_ceiling") == _ANY) | (F.array_max(signature) <= F.log("_ceiling"))
    return F.when(sure, samples).otherwise(F.raise_error(F.lit("a draw has no term below its ceiling: raise SPREAD")).cast("array<double>"))


def likeness(a: str, b: str) -> Column:
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)
    return F.size(same).cast("double") / F.size(a)


def as_text(signature: str) -> Column:
    """Eight hexadecimal digits for each draw."""
    return F.array_join(F.transform(signature, lambda x: F.substring(F.lpad(F.lower(F.hex(F.xxhash64(x))), 16, "0"), 9, 8)), "")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """id and signature of every distinct (id, text), for any table."""
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")) \
        .select("_id", _words("_text").alias("_w"), F.xxhash64("_text").alias("_h")).repartition("_id")
    counted = term_rows(rows, "_w", ["_id", "_h"]).groupBy("_id", "_h", "term").agg(F.count(F.lit(1)).alias("_n"))
    found = signatures(counted.withColumn("_ceiling", F.lit(_ANY)), ["_id", "_h"], samples)
    return found.select(F.col("_id").alias(id_col), settled(F.col("signature")).alias("signature"))


# ----------------------------------------------------------------- successors
def bucket_count(docs: DataFrame) -> int:
    """Buckets of about ``BUCKET`` bytes of text, within once and eight times the
    session's shuffle width: on short texts each further one costs the driver more
    than it spares the tasks."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(buckets(docs.sparkSession, 1), min(buckets(docs.sparkSession, 8), size // BUCKET))


def _longs(values: list[int]) -> Column:
    """An array of numbers as one literal (one for each number is a column each)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _below(cuts: list[int], value: Column) -> Column:
    """How many of the sorted ``cuts`` lie below ``value``: first over every
    s-th cut, then inside one block, so the cost is the root of their number."""
    s = max(1, math.isqrt(len(cuts)))
    heads = cuts[s - 1::s]
    blocks = F.size(F.filter(_longs(heads), lambda x: x < value))
    inside = F.slice(_longs(cuts), blocks * s + 1, F.lit(s))
    return blocks * s + F.size(F.filter(inside, lambda x: x < value))


def with_successor(docs: DataFrame, n: int) -> DataFrame:
    """_bucket, _row (place in the bucket), doc_id, text, _next (text of the next
    row by doc_id; of the first row for the last), _guest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("_ord"))
    parts = [i / n for i in range(1, n)]
    cuts = rows.agg(F.percentile_approx("_ord", parts, 100 * n)).first()[0] if parts else []
    cuts = sorted(set(cuts or []))
    bucket = _below(cuts, F.col("_ord")).cast("int") if cuts else F.lit(0)
    placed = rows.withColumn("_bucket", bucket)
    firsts = {r["_bucket"]: r["m"] for r in  # one row for each bucket at most
              placed.groupBy("_bucket").agg(F.min("_ord").alias("m")).collect()}
    used = sorted(firsts)
    least = [firsts.get(b, 0) for b in range(len(cuts) + 1)]  # no row asks for an empty bucket's
    host = {b: used[i - 1] for i, b in enumerate(used)}  # the first bucket's host is the last one
    hosts = [host.get(b, 0) for b in range(len(cuts) + 1)]
    at = F.col("_bucket") + 1
    is_first = F.col("_ord") == F.element_at(_longs(least), at)
    spots = F.when(is_first, F.array(
        F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("g")),
        F.struct(F.element_at(_longs(hosts), at).cast("int").alias("b"), F.lit(True).alias("g")))
    ).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("g"))))
    spread = (placed.select("doc_id", "text", "_ord", F.explode(spots).alias("_s"))
              .select("doc_id", "text", "_ord", F.col("_s.b").alias("_bucket"), F.col("_s.g").alias("_guest"))
              .repartition(n, "_bucket"))
    order = Window.partitionBy("_bucket").orderBy("_guest", "_ord", "text")
    return spread.select("_bucket", F.row_number().over(order).alias("_row"), "doc_id", "text",
                         F.lead("text").over(order).alias("_next"), "_guest")


def op5_fingerprints(spark, sf_dir: str, samples: int = SAMPLES, spread: float = SPREAD) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_successor(docs, bucket_count(docs))
    half = F.floor(F.length("text") / 2).cast("int")
    both = rows.withColumn("_edited", F.concat(F.substr("text", F.lit(1), F.length("text") - half),
                                               F.substr(F.coalesce("_next", F.lit("")), F.lit(1), half)))
    # doc_id is no part of the key; with it both branches read the same columns
    # of the texts' shuffle, so that it is made once.
    key = ["_bucket", "_row", "doc_id"]
    words = both.select(*key, _words("text").alias("_w0"), _words("_edited").alias("_w1"))
    sides = words.select(*key, ceiling(F.least(F.size("_w0"), F.size("_w1")) - 1, spread).alias("_ceiling"),
                         F.posexplode(F.array("_w0", "_w1")).alias("_side", "_w"))
    terms = term_rows(sides, "_w", [*key, "_ceiling", "_side"]).groupBy(*key, "term").agg(
        F.min("_ceiling").alias("_ceiling"), F.count(F.when(F.col("_side") == _OWN, 1)).alias("_n0"),
        F.count(F.when(F.col("_side") == _EDITED, 1)).alias("_n1"))

    def part(of: int, n: str) -> Column:
        return F.struct(F.lit(of).alias("_of"), F.col(n).alias("_n"))
    parts = (F.when(F.col("_n0") == F.col("_n1"), F.array(part(_SHARED, "_n0"))).when(F.col("_n0") == 0, F.array(part(_EDITED, "_n1")))
             .when(F.col("_n1") == 0, F.array(part(_OWN, "_n0"))).otherwise(F.array(part(_OWN, "_n0"), part(_EDITED, "_n1"))))
    found = signatures(terms.select(*key, "term", "_ceiling", F.inline(parts)), [*key, "_of"], samples)
    least = found.groupBy(*key).agg(F.min("_ceiling").alias("_ceiling"), *[
        F.max(F.when(F.col("_of") == of, F.col("signature"))).alias(f"_s{of}") for of in (_OWN, _EDITED, _SHARED)])

    def lesser(of: int) -> Column:
        nothing = F.array_repeat(F.lit(_NONE), samples)
        return F.zip_with(F.coalesce(f"_s{of}", nothing), F.coalesce(f"_s{_SHARED}", nothing), lambda x, y: F.least(x, y))
    pair = least.select("_bucket", "_row", settled(lesser(_OWN)).alias("own"), settled(lesser(_EDITED)).alias("edited"))
    order = Window.partitionBy("_bucket").orderBy("_row")
    pair = pair.withColumn("after", F.lead("own").over(order))
    facts = both.where(~F.col("_guest")).select(*key, F.length("text").cast("long").alias("n_chars"),
                                                F.sha2("_edited", 256).alias("edited_sha256"))
    return facts.join(pair, ["_bucket", "_row"]).select(
        "doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"), likeness("own", "after").alias("near_next"))
