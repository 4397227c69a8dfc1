"""CSV source and sink (B1, K2) with explicit schemas.

The raw entities arrive as headered CSV files, one per entity. Reading them
with an explicit schema avoids a schema-inference pass over the data; columns
whose text can be dirty (ids written as floats, free-form flags) are read as
STRING and cast by the Silver cleaners.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, DoubleType, LongType, StringType, StructField,
                               StructType, TimestampNTZType)

from ..operators.silver import tolerant_bigint
from . import files


def _schema(*cols) -> StructType:
    return StructType([StructField(n, t, True) for n, t in cols])


S, L, D, B = StringType(), LongType(), DoubleType(), BooleanType()
TS, DT = TimestampNTZType(), DateType()

# Raw entity layouts (column order of the raw CSV files).
RAW_SCHEMAS: dict[str, StructType] = {
    "raw_users": _schema(("user_id", L), ("region", S), ("customer_type", S), ("loyalty_flag", S),
                         ("signup_date", S)),
    "raw_products": _schema(("product_id", L), ("product_name", S), ("category", S), ("base_price", D),
                            ("margin_rate", D)),
    "raw_sessions": _schema(("session_id", L), ("user_id", L), ("session_start", TS), ("device_type", S),
                            ("channel", S)),
    "raw_events": _schema(("event_id", L), ("session_id", L), ("user_id", L), ("event_timestamp", TS),
                          ("event_name", S), ("product_id", S), ("device_type", S), ("region", S),
                          ("customer_type", S), ("loyalty_flag", S), ("channel", S)),
    "raw_orders": _schema(("order_id", L), ("session_id", L), ("user_id", L), ("order_timestamp", TS),
                          ("revenue", D), ("basket_value", D), ("items_count", L), ("device_type", S),
                          ("region", S), ("customer_type", S), ("loyalty_flag", S), ("channel", S),
                          ("variant", S)),
    "raw_experiment_assignments": _schema(("user_id", L), ("experiment_name", S), ("variant", S),
                                          ("assigned_at", TS)),
}
TS_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


# RFC 4180 quoting, blanks kept as they are.
DIALECT = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


CORRUPT = "_corrupt_record"


def quoted_line_breaks(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files at ``path`` without and with a line break inside quotes. A line
    that holds an odd number of quotes opens or closes a field that goes over its
    end (a quote inside a field is doubled), so one pass over the lines tells."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    odd = lines.where(quotes % 2 == 1).select(F.input_file_name().alias("file")).distinct()
    broken = {unquote(r.file) for r in odd.collect()}  # file names
    every = [unquote(f) for f in lines.inputFiles()]
    return [f for f in every if f not in broken], [f for f in every if f in broken]


def read_raw(spark: SparkSession, raw_path: str, entity: str, multi_line: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """B1: ``<raw_path>/<entity>.csv`` (a file or a folder of part files, each with
    a header) as the entity's raw rows, and the rows that are not: (entity, file,
    reason, record) for a wrong number of fields or a value that does not fit its
    column's type. Every row of the files is in one of the two.

    Files without a quoted line break are split over tasks; only those with one are
    read as a whole (``multi_line``: None looks, True or False says so)."""
    path = f"{raw_path.rstrip('/')}/{entity}.csv"
    schema = RAW_SCHEMAS[entity]
    as_read = StructType([StructField(f.name, S, True) for f in schema.fields] + [StructField(CORRUPT, S, True)])

    def text_rows(paths, whole: bool) -> DataFrame:
        return (spark.read.schema(as_read).options(**DIALECT).option("mode", "PERMISSIVE").option("multiLine", whole)
                .option("columnPruning", False)  # a count alone would not see what is wrong with a row
                .option("columnNameOfCorruptRecord", CORRUPT).csv(paths).withColumn("_file", F.col("_metadata.file_name")))
    if multi_line is None:
        plain, broken = quoted_line_breaks(spark, path)
        parts = [text_rows(p, whole) for p, whole in ((plain, False), (broken, True)) if p]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else text_rows(path, False)
    else:
        rows = text_rows(path, multi_line)

    def typed(f: StructField):
        # Whole numbers come as text: an id written as 12.0 is 12.
        c = F.col(f.name)
        return c if f.dataType == S else tolerant_bigint(c) if f.dataType == L else c.try_cast(f.dataType)
    misfit = [F.when(F.col(f.name).isNotNull() & typed(f).isNull(), F.lit(f.name)) for f in schema.fields if f.dataType != S]
    names = F.concat_ws(", ", *misfit) if misfit else F.lit("")
    reason = (F.when(F.col(CORRUPT).isNotNull(), F.lit("wrong number of fields"))
              .when(names != "", F.concat(F.lit("not of the column's type: "), names)))
    judged = rows.withColumn("_reason", reason)
    good = judged.where(F.col("_reason").isNull()).select(*[typed(f).alias(f.name) for f in schema.fields])
    record = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[F.col(f.name) for f in schema.fields])))
    rejects = judged.where(F.col("_reason").isNotNull()).select(
        F.lit(entity).alias("entity"), F.col("_file").alias("file"), F.col("_reason").alias("reason"), record.alias("record"))
    return good, rejects


def ingest_csv(spark: SparkSession, raw_path: str, entity: str, multi_line: bool | None = None) -> DataFrame:
    """The rows of :func:`read_raw`."""
    return read_raw(spark, raw_path, entity, multi_line)[0]


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Headered comma-separated output, overwriting ``path``. ``single_file``
    coalesces to one part file -- only for small marts (a few hundred rows),
    never for entity-sized tables."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode("overwrite").options(**DIALECT).option("timestampNTZFormat", TS_FORMAT)
        .csv(path))
    return path


# Fixed value: the marts exported as CSV (product performance is not exported).
EXPORTED_MARTS = ("gold_daily_kpis", "gold_funnel_metrics", "gold_experiment_results", "gold_segment_performance")


def export_marts(gold: dict[str, DataFrame], out_dir: str, marts=EXPORTED_MARTS) -> dict[str, str]:
    """K2: each exported mart as one file ``<out_dir>/<mart>.csv``. It is written to
    a folder beside and takes its place in one rename: a reader has the old file or
    the new one, and a run that fails leaves the old one."""
    paths = {}
    for mart in marts:
        spark, paths[mart] = gold[mart].sparkSession, f"{out_dir.rstrip('/')}/{mart}.csv"
        beside = f"{out_dir.rstrip('/')}/_{mart}-{uuid.uuid4().hex}"
        write_csv(gold[mart], beside, single_file=True)
        part, = (n for n in files.names(spark, beside) if n.startswith("part-"))
        files.replace(spark, f"{beside}/{part}", paths[mart])
        files.remove(spark, beside)
    return paths


def read_csv_like(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read a headered CSV back with the schema of ``like``."""
    return (spark.read.schema(like.schema).options(**DIALECT).option("multiLine", True)
            .option("timestampNTZFormat", TS_FORMAT).csv(path))
