"""Secret scans (DataFrame functions only).

Base kinds are fixed patterns. On top of them, candidate strings (maximal runs
of a character class) are scored by the Shannon entropy of a sliding window:
the first window is counted once, and each step moves one character out and one
in, so only the two counts that change are updated. A candidate is reported
from the first to the last window that reaches the class's threshold, unless an
allow-list pattern matches the whole candidate or a base span overlaps it.

Positions are code points, ends exclusive. Only rows in which a pattern occurs
build match lists; long candidates are scored in pieces that overlap by a
window less one, so the work is linear in the text.

Defined results: null text counts as empty; empty texts, and texts without
candidates, have no spans; repeated rows each give their own; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_HEAD = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"


@dataclass(frozen=True)
class EntropyClass:
    kind: str
    chars: str        # inside of a character class
    window: int
    threshold: float  # bits per character


# Order of kinds where spans start together.
BASE_KINDS = ("assign", "access", "hex")
CLASSES = (EntropyClass("entropy_hex", "0-9a-fA-F", 16, 3.0),
           EntropyClass("entropy_base64", "A-Za-z0-9+/_=-", 20, 3.9))
# Whole candidates that are not secrets: one kind of character only, plain
# words joined by marks, UUID-like groups, and published sample keys.
ALLOWED = (r"[A-Za-z]+", r"[0-9]+", r"[A-Za-z]+(?:[_/=+-]+[A-Za-z]+)*[_/=+-]*",
           r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r".*EXAMPLE.*")
PIECE = 240
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def _no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, add) -> Column:
    """Running totals (or maxima, by ``add``) of an array, in about log2(n) passes:
    each adds to a place what stands a power of two before it."""
    passes = F.when(F.size(values) > 1, F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1), lambda i: F.pow(F.lit(2), i).cast("int"))) \
        .otherwise(F.array().cast("array<int>"))
    return F.aggregate(passes, values, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, add(x, F.get(acc, i - d))).otherwise(x)))


def _located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, whole, part>> of the matches: ``part`` is ``group``.
    A match ends where the texts between matches and the matches so far end."""
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("wholes"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("parts"))

    def places(f):
        lengths = F.transform(f["wholes"], lambda w, i: (F.length(F.get(f["gaps"], i)) + F.length(w)).cast("long"))
        return _let(lengths, lambda n: F.zip_with(F.arrays_zip(f["wholes"].alias("whole"), f["parts"].alias("part")), _running(n, lambda a, b: a + b),
                                                  lambda x, end: F.struct((end - F.length(x["whole"])).alias("start"), x["whole"].alias("whole"), x["part"].alias("part"))))
    return _let(found, places)


def _span(x: Column, rank: int, kind: str, begin: Column | int = 0, end: Column | None = None) -> Column:
    end = F.length(x["whole"]) if end is None else end
    begin = F.lit(begin) if isinstance(begin, int) else begin
    return F.struct((x["start"] + begin).cast("long").alias("start"), F.lit(rank).alias("rank"),
                    (x["start"] + end).cast("long").alias("end"), F.lit(kind).alias("kind"))


def _base(text: Column, rank: int, kind: str, pattern: str, test: str, group: int, least: int) -> Column:
    found = F.filter(_located(text, pattern, group), lambda x: F.length(x["part"]) >= least)
    return F.when(F.rlike(text, F.lit(test)), F.transform(found, lambda x: _span(x, rank, kind))).otherwise(_no_spans())


def _xlog(n: Column, window: int) -> Column:
    """n * log2(n) from a list of constants."""
    return F.element_at(F.array(*[F.lit(i * math.log2(i) if i else 0.0) for i in range(window + 2)]), n + 1)


def _hits(piece: Column, c: EntropyClass) -> Column:
    """struct<first, last>: offsets of the first and last window of ``piece``
    whose entropy reaches the threshold; null without such a window."""
    w, whole = c.window, math.log2(c.window)
    most = (whole - c.threshold) * w + 1e-9  # entropy >= threshold  <=>  sum of n*log2(n) <= most

    def times(ch, s):
        return (F.length(s) - F.length(F.replace(s, ch, F.lit("")))).cast("int")
    opening = F.substring(piece, 1, w)
    total = F.aggregate(F.array_distinct(F.split(opening, "")), F.lit(0.0), lambda a, ch: a + _xlog(times(ch, opening), w))
    seed = F.struct(total.alias("total"), F.when(total <= most, F.lit(0)).alias("first"), F.when(total <= most, F.lit(0)).alias("last"))

    def slide(acc, i):  # the window moves from i-1 to i
        before = F.substr(piece, i, F.lit(w))
        out, into = F.substr(piece, i, F.lit(1)), F.substr(piece, i + w, F.lit(1))
        n_out, n_in = times(out, before), times(into, before)
        moved = acc["total"] - _xlog(n_out, w) + _xlog(n_out - 1, w) - _xlog(n_in, w) + _xlog(n_in + 1, w)
        now = F.when(out == into, acc["total"]).otherwise(moved)
        hit = now <= most
        return F.struct(now.alias("total"), F.coalesce(acc["first"], F.when(hit, i)).alias("first"), F.when(hit, i).otherwise(acc["last"]).alias("last"))
    steps = F.when(F.length(piece) > w, F.sequence(F.lit(1), F.length(piece) - w)).otherwise(F.array().cast("array<int>"))
    return F.when(F.length(piece) >= w, F.aggregate(steps, seed, slide, lambda acc: F.when(acc["first"].isNotNull(), F.struct(acc["first"].alias("first"), acc["last"].alias("last")))))


def _entropy(text: Column, rank: int, c: EntropyClass, allowed: tuple[str, ...]) -> Column:
    pattern = f"[{c.chars}]{{{c.window},}}"
    found = _located(text, pattern)
    if allowed:
        allow = "^(?:" + "|".join(allowed) + ")$"
        found = F.filter(found, lambda x: ~F.rlike(x["whole"], F.lit(allow)))

    def score(x):
        cut = F.regexp_extract_all(x["whole"], F.lit(f".{{1,{PIECE}}}"), F.lit(0))
        # Each piece takes the head of the next one along, so no window is missed.
        nexts = F.concat(F.slice(cut, F.lit(2), F.size(cut)), F.array(F.lit("")))
        pieces = F.zip_with(cut, nexts, lambda a, b: F.concat(a, F.substring(b, 1, c.window - 1)))
        hits = F.filter(F.transform(pieces, lambda p, i: F.struct((i * PIECE).alias("at"), _hits(p, c).alias("h"))), lambda h: h["h"].isNotNull())
        first = F.array_min(F.transform(hits, lambda h: h["at"] + h["h"]["first"]))
        last = F.array_max(F.transform(hits, lambda h: h["at"] + h["h"]["last"]))
        return F.when(F.size(hits) > 0, _span(x, rank, c.kind, first, last + c.window))
    spans = F.filter(F.transform(found, score), lambda s: s.isNotNull())
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(_no_spans())


def scan(docs: DataFrame, text_col: str = "text", classes: tuple[EntropyClass, ...] = CLASSES,
         allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, rank, end, kind)
    ordered by start, then kind as listed. ``spans`` holds the base ones too."""
    text = text_or_empty(text_col)
    rows = docs.withColumn("base_spans", F.array_sort(F.concat(
        _base(text, 0, "assign", ASSIGN, ASSIGN_HEAD, 2, 12),
        _base(text, 1, "access", ACCESS, r"AKIA[A-Z0-9]{14}", 0, 18),
        # Matches of [0-9a-f]+ are maximal runs, so asking for 16 of them finds the same ones.
        _base(text, 2, "hex", r"[0-9a-f]{16,}", r"[0-9a-f]{16}", 0, 16))))
    extra = F.concat(*[_entropy(text, len(BASE_KINDS) + i, c, allowed) for i, c in enumerate(classes)]) if classes else _no_spans()
    rows = rows.withColumn("_extra", extra)
    free = F.filter("_extra", lambda s: ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.withColumn("spans", F.array_sort(F.concat("base_spans", free))).drop("_extra")


def joined(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Spans of every document: doc_id, counts of the base kinds, base_sha256, spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    def count(kind):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS],
                        F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact_secrets(spark, docs: DataFrame, sf_dir: str | None = None, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and n_chars, if there is one,
    brought up to date (pipeline stage); all documents stay. Overlapping spans are replaced
    once, over their union. Null texts stay null."""
    # The document goes along as one column, so its own columns may have any names.
    rows = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), "text"))
    text, spans = F.col("text"), F.col("spans")
    ends = _running(F.transform(spans, lambda s: s["end"]), F.greatest)

    def piece(s, i, reach):  # the text since the spans before, and a mark; nothing for a span that overlaps them
        since = F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0))
        return F.when(s["start"] >= since, F.concat(F.substr(text, (since + 1).cast("int"), (s["start"] - since).cast("int")), F.lit(mark))).otherwise(F.lit(""))
    cut = _let(ends, lambda reach: F.concat(F.array_join(F.transform(spans, lambda s, i: piece(s, i, reach)), ""),
                                            F.substr(text, (F.get(reach, F.size(reach) - 1) + 1).cast("int"), F.length(text))))
    clean = rows.select("document", F.size(spans) > 0, F.when(F.size(spans) > 0, cut).otherwise(text)).toDF("document", "hit", "clean")

    def column(name):
        old = F.col("document").getField(name)
        if name == "text":
            return F.col("clean").alias(name)
        if name == "n_chars":
            return F.when(F.col("hit"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(old).alias(name)
        return old.alias(name)
    return clean.select(*[column(c) for c in docs.columns])


def oracle_sql() -> str:
    """The same spans in DuckDB: matches by cumulated lengths, entropy by counting
    the characters of every window anew."""
    def quoted(text):
        return "'" + text.replace("'", "''") + "'"

    def located(name, rank, kind, pattern, group, test):
        return f"""{name} AS (
  SELECT doc_id, {rank} AS rank, {quoted(kind)} AS kind, whole, part,
         list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(wholes[1:i - 1], lambda g: length(g))), 0) AS start
  FROM (SELECT doc_id, string_split_regex(text, {quoted(pattern)}) AS gaps, wholes, unnest(range(1, len(wholes) + 1)) AS i,
               unnest(wholes) AS whole, unnest(regexp_extract_all(text, {quoted(pattern)}, {group})) AS part
        FROM (SELECT *, regexp_extract_all(text, {quoted(pattern)}) AS wholes FROM d)) x
  WHERE {test})"""
    ctes = [located("k0", 0, "assign", ASSIGN, 2, "length(part) >= 12"), located("k1", 1, "access", ACCESS, 0, "length(part) >= 18"),
            located("k2", 2, "hex", HEX, 0, "length(part) >= 16"),
            """base AS (SELECT doc_id, rank, kind, start, start + length(whole) AS stop FROM
  (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2) x)"""]
    extra = []
    for i, c in enumerate(CLASSES):
        allowed = quoted("(?:" + "|".join(ALLOWED) + ")")
        ctes.append(located(f"c{i}", 3 + i, c.kind, f"[{c.chars}]{{{c.window},}}", 0, f"NOT regexp_full_match(whole, {allowed})"))
        ctes.append(f"""w{i} AS (
  SELECT doc_id, rank, kind, start, o, ch, count(*) AS n FROM (
    SELECT doc_id, rank, kind, start, o, unnest(string_split(substring(whole, (o + 1)::INTEGER, {c.window}), '')) AS ch
    FROM (SELECT *, unnest(range(0, length(whole) - {c.window} + 1)) AS o FROM c{i}) y) z GROUP BY ALL),
h{i} AS (
  SELECT doc_id, rank, kind, start, o FROM w{i} GROUP BY ALL
  HAVING log2({c.window}) - sum(n * log2(n)) / {c.window} >= {c.threshold} - 1e-9)""")
        extra.append(f"SELECT doc_id, rank, kind, start + min(o) AS start, start + max(o) + {c.window} AS stop FROM h{i} GROUP BY doc_id, rank, kind, h{i}.start")
    ctes.append("extra AS (SELECT * FROM (" + " UNION ALL ".join(extra) + """) x WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.start < x.stop AND x.start < b.stop))""")
    return "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),\n" + ",\n".join(ctes) + """,
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex, string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, rank) AS spans
      FROM base GROUP BY doc_id),
f AS (SELECT doc_id, string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, rank) AS spans
      FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(g.spans, '')) AS base_sha256, coalesce(f.spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN f USING (doc_id)"""
