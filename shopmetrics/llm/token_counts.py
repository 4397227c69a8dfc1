"""Token counts as delta-maintained rollups.

A ledger of immutable batches on shared storage keeps additive totals of
documents and tokens by (source, lang, tokenizer version). A batch brings
inserts, revised counts and deletes; for each changed document the operator
looks up what the ledger holds for it and adds signed rows to the totals: the
old count with a minus, the new one with a plus. Totals are the sum of the
batches' deltas; no document is counted again.

Layout below ``root``:
  batches/<batch>-<attempt>/state   current row of each changed (doc_id, tokenizer)
  batches/<batch>-<attempt>/delta   signed sums by (source, lang, tokenizer)
  commits/<seq>-<batch>-<attempt>   empty marker, made once the attempt is whole
Readers follow markers only, so half-written attempts are invisible; a batch id
that has a marker is skipped, so redelivery changes nothing. Batches are applied
by one writer, one after the other.

Defined results
- insert and revise both set the count of (doc_id, tokenizer), so an insert of a
  known document counts as a revision; a delete of an unknown one does nothing;
- several changes of one key in a batch: the one with the largest ``seq`` holds,
  then delete before insert/revise, then the largest row;
- null source, lang or doc_id are values of their own; a null count is 0;
- an empty batch is committed and changes nothing; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import WORD, table, text_or_empty

KEY = ["doc_id", "tokenizer"]
DIMS = ["source", "lang", "tokenizer"]
STATE = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint, live boolean, batch_seq int"
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"

WORD_PUNCT = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def commits(self) -> list[tuple[int, str, str]]:
        """(sequence, batch id, folder) of every committed batch, in order."""
        at = self._path("commits")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        found = []
        for name in names:
            seq, rest = name.split("-", 1)
            found.append((int(seq), rest.rsplit("-", 1)[0], rest))
        return sorted(found)

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/batches/{folder}/{part}" for _, _, folder in self.commits()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def state(self) -> DataFrame:
        """Latest row of every (doc_id, tokenizer) the ledger has seen."""
        last = F.max_by(F.struct("source", "lang", "n_tokens", "live"), "batch_seq")
        return self._read("state", STATE).groupBy(*KEY).agg(last.alias("old"))

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by source, lang and tokenizer; empty cells are left out."""
        return (self._read("delta", DELTA).groupBy(*DIMS)
                .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .where("n_docs <> 0 or n_tokens <> 0"))

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch of (doc_id, tokenizer, source, lang, n_tokens, op[, seq]),
        op being insert, revise or delete. False if it was committed before."""
        done = self.commits()
        if batch_id in {b for _, b, _ in done}:
            return False
        seq = 1 + max((s for s, _, _ in done), default=0)
        folder = f"{batch_id}-{uuid.uuid4().hex}"
        at = f"{self.root}/batches/{folder}"
        order = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        new = F.struct(order.alias("seq"), (F.col("op") != "delete").alias("live"),
                       F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")).alias("n_tokens"))
        last = (changes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokenizer").cast("string").alias("tokenizer"), new.alias("new"))
                .groupBy(*KEY).agg(F.max("new").alias("new")))
        if done:
            old = self.state().select(F.col("doc_id").alias("_d"), F.col("tokenizer").alias("_t"), "old")
            last = last.join(old, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("tokenizer").eqNullSafe(F.col("_t")), "left").drop("_d", "_t")
        else:
            last = last.withColumn("old", F.lit(None).cast("struct<source:string,lang:string,n_tokens:bigint,live:boolean>"))
        was = F.coalesce(F.col("old.live"), F.lit(False))
        # A delete needs something to delete, and the ledger keeps whose it was.
        changed = last.where(F.col("new.live") | was).select(
            *KEY, "old", "new", was.alias("was"), F.when(F.col("new.live"), F.col("new.source")).otherwise(F.col("old.source")).alias("source"),
            F.when(F.col("new.live"), F.col("new.lang")).otherwise(F.col("old.lang")).alias("lang"))
        changed.select(*KEY, "source", "lang", F.col("new.n_tokens").alias("n_tokens"), F.col("new.live").alias("live"),
                       F.lit(seq).alias("batch_seq"), F.col("was"), F.col("old")).write.parquet(f"{at}/state")
        # The signed rows are taken from what was written, not computed again.
        rows = self.spark.read.parquet(f"{at}/state")
        one = F.lit(1).cast("long")
        signed = F.array(
            F.when(F.col("live"), F.struct(F.col("source"), F.col("lang"), one.alias("d"), F.col("n_tokens").alias("n"))),
            F.when(F.col("was"), F.struct(F.col("old.source").alias("source"), F.col("old.lang").alias("lang"),
                                          (-one).alias("d"), (-F.col("old.n_tokens")).alias("n"))))
        (rows.select("tokenizer", F.explode(signed).alias("s")).where("s is not null")
         .groupBy("s.source", "s.lang", "tokenizer").agg(F.sum("s.d").alias("n_docs"), F.sum("s.n").alias("n_tokens"))
         .where("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{at}/delta"))
        self._fs.create(self._path("commits", f"{seq:08d}-{folder}"), False).close()
        return True


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def native_counts(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) under two versions of a simple
    tokenizer: runs of non-blanks, and words or single marks."""
    text = text_or_empty("text") if text is None else text
    versions = F.array(*[F.struct(F.lit(v).alias("tokenizer"), count_matches(text, p).alias("n_tokens"))
                         for v, p in (("words-1", WORD), ("word-punct-2", WORD_PUNCT))])
    return docs.select("doc_id", "source", "lang", F.inline(versions))


def bpe_counts(docs: DataFrame, ranks_path: str, pattern: str, version: str) -> DataFrame:
    """The same rows under a byte-level BPE vocabulary (a rank file)."""
    def count(batches):
        import base64

        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            pdf["n_tokens"] = [len(enc.encode_ordinary(t or "")) for t in pdf.pop("text")]
            pdf["tokenizer"] = version
            yield pdf[["doc_id", "source", "lang", "tokenizer", "n_tokens"]]
    return docs.select("doc_id", "source", "lang", "text").mapInPandas(
        count, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals by source, lang and tokenizer version after four deliveries: all
    documents inserted; documents holding e-mail addresses revised to the count
    of the text with each address as one word; documents labelled as low quality
    deleted; and the revision delivered a second time, which changes nothing."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    ledger = Ledger(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}")
    inserts = native_counts(docs).withColumn("op", F.lit("insert"))
    with_mail = docs.where(F.col("text").rlike(EMAIL))
    revised = native_counts(with_mail, F.regexp_replace("text", EMAIL, "EMAIL")).withColumn("op", F.lit("revise"))
    low = labels.where("quality = 0").select("doc_id").distinct()
    deletes = (low.select("doc_id", F.explode(F.array(F.lit("words-1"), F.lit("word-punct-2"))).alias("tokenizer"))
               .select("doc_id", "tokenizer", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"),
                       F.lit(None).cast("long").alias("n_tokens"), F.lit("delete").alias("op")))
    for name, changes in (("load", inserts), ("mask", revised), ("quality", deletes), ("mask", revised)):
        ledger.apply(name, changes)
    return ledger.totals()


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, lang, regexp_replace(coalesce(text, ''), '{EMAIL}', 'EMAIL', 'g') AS t FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
), c AS (
  SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(t, '{WORD}')) AS n FROM d
  UNION ALL
  SELECT source, lang, 'word-punct-2', len(regexp_extract_all(t, '{WORD_PUNCT}')) FROM d
)
SELECT source, lang, tokenizer, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM c GROUP BY ALL
"""
