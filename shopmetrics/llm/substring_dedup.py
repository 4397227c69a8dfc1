"""Substring dedup over sliding sentence spans.

Texts are cut into sentences; every run of ``run`` consecutive sentences with at
least ``min_words`` words in all is hashed (SHA-256, cut to 128 bits, over its
words with single spaces). Equal spans are found by one global aggregation on
the hash; the first span by (doc_id, sentence) is the original, and every
sentence that lies in a later one is removed. This is op4_substring_dedup, and
what its SQL repeats. op4_passage_dedup also removes passages of ``width`` or
more words that are equal wherever they start and end (passages.py), to the
word: from texts without marks, and with the cut sentences at both ends.

Plan: spans (hash, doc_id, position) are made in the scan; an aggregation with
map-side combine gives the first place of each hash that occurs again; a join
back on the hash, which adaptive execution splits where a passage is common,
gives the places to remove; these are gathered per document and cut out of the
text. Only hashes and places are shuffled for all spans; a list is gathered per
document only, and holds no more than the document's sentences, or words where
passages are asked for; then the texts are cut in Python, batch by batch.

Defined results
- null text counts as empty; texts with fewer than ``run`` sentences, or with no
  span of ``min_words`` words, are unchanged; white space in a span does not
  matter, letters and marks do;
- a word is a run of non-blanks, and goes with the blanks behind it; passages
  have the same order as spans, and equal texts of ``width`` words are one;
- of equal spans inside one text the first stays; overlapping spans are removed
  over their union; kept sentences stay as they are, with what separates them;
- rows that share a doc_id are told apart by their text; rows that repeat both
  are one document and have equal rows in the result (this operator removes
  passages, not rows);
- a null doc_id comes after all others, so it never is the original;
- extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, table, text_or_empty
from .passages import WIDTH, repeated_passages

RUN = 2
MIN_WORDS = 8
_NUL = "\x00"
# A sentence ends at a line feed, or at the blanks after a closing mark.
_END = r"(\n+|[.!?]+[\x20\x09-\x0D]+)"


def sentences(text: Column) -> Column:
    """The sentences of ``text``, each with what follows it up to the next, so
    that their concatenation is the text."""
    plain = F.replace(text, F.lit(_NUL), F.lit(" "))  # the cut mark must not occur
    return F.array_remove(F.split(F.regexp_replace(plain, _END, "$1" + _NUL), _NUL), "")


def _spans(docs: DataFrame, run: int, min_words: int) -> DataFrame:
    """(doc_id, doc_hash, at, span): hash of the span that starts at sentence ``at``."""
    parts = docs.select("doc_id", "doc_hash", F.transform(sentences(F.col("text")), lambda s: F.trim(F.regexp_replace(s, r"[\x20\x09-\x0D]+", " "))).alias("s"))
    # Line i of the zip holds sentences i, i+1, ...; the last ones run out and are null.
    shifted = [F.slice("s", F.lit(i + 1), F.greatest(F.size("s") - (run - 1), F.lit(0))).alias(f"s{i}") for i in range(run)]
    lines = parts.where(F.size("s") >= run).select("doc_id", "doc_hash", F.posexplode(F.arrays_zip(*shifted)).alias("at", "x"))
    joined = F.concat_ws(" ", *[F.col(f"x.s{i}") for i in range(run)])
    span = lines.select("doc_id", "doc_hash", "at", joined.alias("j"))
    words = F.length("j") - F.length(F.replace("j", F.lit(" "), F.lit(""))) + 1
    return span.where(words >= min_words).select("doc_id", "doc_hash", "at", F.substring(F.unhex(F.sha2("j", 256)), 1, 16).alias("span"))


def repeated_sentences(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, doc_hash, covered): places of the sentences to remove, per document."""
    spans = _spans(docs, run, min_words)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "doc_hash", "at")
    again = (spans.groupBy("span").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("span", "first"))
    later = spans.join(again, "span").where(place != F.col("first")).select("doc_id", "doc_hash", "at")
    return (later.groupBy("doc_id", "doc_hash").agg(F.collect_set("at").alias("starts"))
            .select("doc_id", "doc_hash", F.array_distinct(F.flatten(F.transform("starts", lambda a: F.sequence(a, a + run - 1)))).alias("covered")))


def remove_repeats(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_sentences, n_removed, chars_removed, text (what is left) of
    every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.replace(text_or_empty("text"), F.lit(_NUL), F.lit(" ")).alias("text")) \
        .withColumn("doc_hash", F.xxhash64("text"))
    found = durable(repeated_sentences(rows, run, min_words)).select(F.col("doc_id").alias("_d"), F.col("doc_hash").alias("_h"), "covered")
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("doc_hash") == F.col("_h")), "left")
    s = sentences(F.col("text"))
    mark = F.array_sort("covered")
    cut = F.aggregate(
        mark, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, i: F.struct((i + 1).alias("at"), F.when(i > acc["at"], F.concat(acc["out"], F.slice("_s", acc["at"] + 1, i - acc["at"]))).otherwise(acc["out"]).alias("out")),
        lambda acc: F.array_join(F.concat(acc["out"], F.slice("_s", acc["at"] + 1, F.size("_s"))), ""))
    cutting = both.withColumn("_s", s)
    left = F.when(F.col("covered").isNull(), F.col("text")).otherwise(cut)
    return (cutting.select("doc_id", F.size("_s").cast("long").alias("n_sentences"),
                           F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
                           F.length("text").alias("_chars"), left.alias("text"))
            .select("doc_id", "n_sentences", F.greatest("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                    (F.col("_chars") - F.length("text")).cast("long").alias("chars_removed"), "text"))


def _cut(batches):
    """The rows with ``covered`` (sentences) and ``ranges`` (words) cut out of the text."""
    ends, word = re.compile(_END), re.compile(r"[^\x20\x09-\x0D]+")

    def left(text, covered, ranges):
        stops = [m.end() for m in ends.finditer(text)]
        if text and (not stops or stops[-1] < len(text)):
            stops.append(len(text))
        begins = [0, *stops]
        gone = [(begins[i], stops[i]) for i in covered or ()]
        if ranges:
            at = [m.start() for m in word.finditer(text)]
            n = len(at)
            at.append(len(text))  # blanks go with the word before them
            gone += [(at[r["start"]], at[min(r["end"], n)]) for r in ranges if r["start"] < n]
        union = []
        for a, b in sorted(gone):
            if union and a <= union[-1][1]:
                union[-1][1] = max(union[-1][1], b)
            else:
                union.append([a, b])
        out, last, n_removed, k = [], 0, 0, 0
        for a, b in union:
            out.append(text[last:a])
            last = b
            while k < len(stops) and begins[k] < a:
                k += 1
            while k < len(stops) and stops[k] <= b:
                n_removed, k = n_removed + 1, k + 1
        return "".join([*out, text[last:]]), n_removed

    for batch in batches:
        texts = batch.column("text").to_pylist()
        removed, chars = [0] * len(texts), [0] * len(texts)
        for i, (covered, ranges) in enumerate(zip(batch.column("covered").to_pylist(), batch.column("ranges").to_pylist())):
            if covered or ranges:
                before = len(texts[i])
                texts[i], removed[i] = left(texts[i], covered, ranges)
                chars[i] = before - len(texts[i])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_sentences"), pa.array(removed, pa.int64()), pa.array(chars, pa.int64()), pa.array(texts, pa.string())],
            names=["doc_id", "n_sentences", "n_removed", "chars_removed", "text"])


def remove_passages(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, width: int = WIDTH) -> DataFrame:
    """As :func:`remove_repeats`, and without every word of a repeated passage of
    ``width`` words; n_removed counts the sentences that went whole."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.replace(text_or_empty("text"), F.lit(_NUL), F.lit(" ")).alias("text")) \
        .withColumn("doc_hash", F.xxhash64("text"))
    by_sentence = repeated_sentences(rows, run, min_words).withColumn("ranges", F.lit(None).cast("array<struct<start:bigint,end:bigint>>"))
    by_passage = repeated_passages(rows, width).withColumn("covered", F.lit(None).cast("array<int>"))
    found = durable(by_sentence.unionByName(by_passage).groupBy("doc_id", "doc_hash").agg(
        F.first("covered", True).alias("covered"), F.first("ranges", True).alias("ranges"))) \
        .select(F.col("doc_id").alias("_d"), F.col("doc_hash").alias("_h"), "covered", "ranges")
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("doc_hash") == F.col("_h")), "left")
    return both.select("doc_id", F.size(sentences(F.col("text"))).cast("long").alias("n_sentences"), "text", "covered", "ranges") \
        .mapInArrow(_cut, "doc_id long, n_sentences long, n_removed long, chars_removed long, text string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_passage_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split(regexp_replace(coalesce(text, ''), '(\n+|[.!?]+[\x20\x09-\x0D]+)', '\1~|~', 'g'), '~|~'), lambda x: x <> '') AS s
  FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(s) + 1)) AS pos, unnest(s) AS raw FROM d
), w AS (
  SELECT doc_id, pos, raw, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS one FROM p
), n AS (
  SELECT *, one || ' ' || lead(one) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM w
), f AS (
  SELECT *, row_number() OVER (PARTITION BY span ORDER BY doc_id, pos) AS k
  FROM n WHERE span IS NOT NULL AND len(span) - len(replace(span, ' ', '')) + 1 >= {MIN_WORDS}
), gone AS (
  SELECT DISTINCT doc_id, unnest([pos, pos + 1]) AS pos FROM f WHERE k > 1
), kept AS (
  SELECT w.doc_id, count(*) AS n_sentences, count(g.pos) AS n_removed,
         coalesce(string_agg(CASE WHEN g.pos IS NULL THEN raw END, '' ORDER BY w.pos), '') AS text
  FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed,
       (length(d.text) - length(coalesce(k.text, '')))::BIGINT AS chars_removed, coalesce(k.text, '') AS text
FROM d LEFT JOIN kept k USING (doc_id)
"""
