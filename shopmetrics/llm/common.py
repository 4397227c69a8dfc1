"""Shared pieces of the training-data operators: table access, durable
intermediates, text normalisation and skew-safe ranks."""

from __future__ import annotations

import io
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# ASCII white space, as the contracts define it.
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """Cut the lineage: a Parquet table in a folder of its own below the folder
    all executors share (``spark.checkpoint.dir``). A lost executor costs a
    re-read and not a recomputation; columns stay prunable, sizes are known to
    the planner, and (unlike after ``checkpoint()``) no inferred constraints of
    the plan behind are carried on, which grow from turn to turn in a loop."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


durable = written


def forget(*frames: DataFrame | None) -> None:
    """Delete tables of :func:`written` that nothing lazy refers to any more."""
    for df in frames:
        path = getattr(df, "_written_to", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
            df._written_to = None


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def one_space(text: Column) -> Column:
    """Every run of ASCII white space as one space. The pattern skips runs that
    already are a single space, which most are."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def buckets(spark: SparkSession, factor: int = 4) -> int:
    """Salt count that follows the session's shuffle width."""
    return factor * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def rank_within(df: DataFrame, key: str, order: list[str], salt: Column, out: str) -> DataFrame:
    """0-based dense numbering of the rows of each ``key``, without one task ever
    holding a whole key: rows are numbered per (key, salt) and shifted by the
    sizes of the salts before. ``df`` is read twice and should be durable."""
    rows = df.withColumn("_salt", salt)
    sizes = rows.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_salt").orderBy(*order)
    return (rows.withColumn("_rank", F.row_number().over(inside) - 1)
            .join(shift, [key, "_salt"])
            .withColumn(out, (F.col("_before") + F.col("_rank")).cast("long"))
            .drop("_salt", "_before", "_rank"))


def small_enough(df: DataFrame, row_bytes: int = 64, limit_bytes: int = 8 << 20) -> DataFrame:
    """``df`` marked for broadcast if it was counted to be within ``limit_bytes``;
    unmarked otherwise, so that the join shuffles. ``df`` should be durable."""
    return F.broadcast(df) if df.count() * row_bytes <= limit_bytes else df


def own_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names for a step's own use that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


_KEPT: list = []


def kept(make):
    """``make`` with its last two results kept by the worker process from task to
    task, until a task that needs the memory calls :func:`drop_kept`."""
    _KEPT.append(lru_cache(maxsize=2)(make))
    return _KEPT[-1]


def drop_kept() -> None:
    for make in _KEPT:
        make.cache_clear()


BATCH_ROWS = 1_000
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each application: a zip in
    the shared folder, registered with the context. Needed where the executors
    have not installed it; tasks that run Python functions call it."""
    # Whole texts are long: a batch of the usual 10,000 would take tens of MB on
    # both sides of the pipe.
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, min(BATCH_ROWS, int(spark.conf.get(name)) or BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/code-{uuid.uuid4().hex}/{package.name}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(at)
    _SHIPPED.add(sc.applicationId)
