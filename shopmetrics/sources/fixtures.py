"""Fixture adapter: the driver's star-schema tables -> the six raw shop entities.

The shop expects raw users, products, sessions, events, orders and
experiment assignments. The test tables are TPC-H-like (customer, nation,
region, orders, part) plus an ``events`` stream, so this module derives the
shop entities from them with plain DataFrame expressions. A "session" is one
user on one calendar day. The adapter injects dirt on purpose (duplicate ids,
NULL timestamps, mixed case, float-typed product ids, zero/negative revenue,
duplicate assignments, an off-list event) so every cleaning rule is exercised.

Every entity is a lazy DataFrame over the parquet files, so filters and column
pruning reach the scans.
"""

from __future__ import annotations

import datetime as _dt
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import state

# Fixed values of the adapter contract (must equal the oracle SQL).
EVENT_NAME_MAP = {
    "view": "homepage_view",
    "click": "product_view",
    "signup": "add_to_basket",
    "purchase": "payment_complete",
}
EXPERIMENT_NAME = "checkout_friction_reduction"
PRIMARY_ASSIGNED_AT = _dt.datetime(2024, 1, 1, 0, 0, 0)
REPEAT_ASSIGNED_AT = _dt.datetime(2024, 1, 5, 0, 0, 0)
LOYAL_SEGMENTS = ("BUILDING", "HOUSEHOLD")

RAW_TABLES = ("region", "nation", "customer", "orders", "part", "events")
SOURCE_TABLES = (*RAW_TABLES, "documents", "conversations")
FOLDER_FILES = 5_000  # of a folder of documents, about


_MEMO: dict[tuple, DataFrame] = {}
_STATES: dict[tuple, str] = {}


def _session_key(spark: SparkSession) -> str:
    from ..session import app_key
    return app_key(spark)


def source_state(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the source files. Where it has changed since it was last asked
    for, the DataFrames that were built over the old files are forgotten."""
    at = (_session_key(spark), sf_dir.rstrip("/"))
    now = state(spark, [f"{at[1]}/{t}.parquet" for t in SOURCE_TABLES])
    if _STATES.get(at) != now:
        for key in [k for k in _MEMO if k[1:3] == at]:
            del _MEMO[key]
        _STATES[at] = now
    return now


def memo_per_source(fn):
    """Build each derived DataFrame once per (application, sf_dir): the plan
    objects are immutable, so every query of a run shares them (and the file
    listing / footer reads of their scans). :func:`source_state` notices changed
    files; each query asks it once."""
    @functools.wraps(fn)
    def wrapper(spark: SparkSession, sf_dir: str, *args):
        key = (fn.__name__, _session_key(spark), sf_dir.rstrip("/"), args)
        df = _MEMO.get(key)
        if df is None:
            df = _MEMO[key] = fn(spark, sf_dir, *args)
        return df
    return wrapper


@memo_per_source
def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts_ntz(value: _dt.datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def _event_name(col: Column) -> Column:
    expr = None
    for src, dst in EVENT_NAME_MAP.items():
        expr = (F.when(col == src, F.lit(dst)) if expr is None
                else expr.when(col == src, F.lit(dst)))
    return expr.otherwise(col)


@memo_per_source
def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ev``: events with a session id (user x day-of-year), shop event names
    and the integer ``k`` from the props JSON."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "ts",
        (F.col("user_id") * 10_000_000 + F.year("ts") * 1000 + F.dayofyear("ts")).alias("session_id"),
        _event_name(F.col("event_type")).alias("event_name"),
        "value",
        F.regexp_extract("props", r"([0-9]+)", 1).cast("bigint").alias("k"),
    )


@memo_per_source
def _user_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer x nation x region -> user id and the three user dimensions."""
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("c_custkey").alias("user_id"),
            F.col("r_name").alias("region"),
            F.when(F.col("c_nationkey") % 3 == 0, F.lit("new")).otherwise(F.lit("returning")).alias("customer_type"),
            F.col("c_mktsegment").isin(*LOYAL_SEGMENTS).alias("loyalty_flag"),
        )
    )


@memo_per_source
def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    # Pre-aggregate orders to one row per customer before the join.
    first_order = o.groupBy(F.col("o_custkey").alias("user_id")).agg(F.min("o_orderdate").alias("first_order"))
    return (
        _user_attrs(spark, sf_dir)
        .join(first_order, "user_id", "left")
        .select("user_id", "region", "customer_type", "loyalty_flag",
                F.col("first_order").cast("date").alias("signup_date"))
    )


@memo_per_source
def raw_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = base_events(spark, sf_dir)
    g = ev.groupBy("session_id", "user_id").agg(
        F.min("ts").alias("session_start"),
        F.min_by("k", "ts").alias("k0"),
    )
    return g.select(
        "session_id", "user_id", "session_start",
        F.when(F.col("k0") % 3 == 0, F.lit("Mobile"))
         .when(F.col("k0") % 3 == 1, F.lit("desktop"))
         .otherwise(F.lit("tablet")).alias("device_type"),
        F.when(F.col("k0") % 2 == 0, F.lit("APP")).otherwise(F.lit("web")).alias("channel"),
    )


@memo_per_source
def _events_with_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ev`` joined to its raw session and raw user (the shared part of
    raw events and raw orders)."""
    ev = base_events(spark, sf_dir)
    s = raw_sessions(spark, sf_dir).select("session_id", "device_type", "channel")
    u = _user_attrs(spark, sf_dir)
    return ev.join(s, "session_id").join(u, "user_id")


@memo_per_source
def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events_with_dims(spark, sf_dir)
    # Every 50th event also arrives as a late duplicate copy renamed to an
    # off-list event: one pass that emits one or two rows per event (explode)
    # instead of a second scan-and-join branch.
    copy = F.explode(F.when(F.col("event_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    e = e.select("*", copy.alias("_copy"))
    late = F.col("_copy") == 1
    ts = F.when(F.col("event_id") % 97 == 0, F.lit(None)).otherwise(F.col("ts"))
    name = F.when(F.col("event_id") % 2 == 0, F.upper("event_name")).otherwise(F.col("event_name"))
    return e.select(
        "event_id", "session_id", "user_id",
        F.when(late, ts + F.expr("INTERVAL 1 MINUTE")).otherwise(ts).alias("event_timestamp"),
        F.when(late, F.lit("error")).otherwise(name).alias("event_name"),
        F.when(F.col("event_name").isin("product_view", "add_to_basket"),
               F.concat(F.col("k").cast("string"), F.lit(".0"))).alias("product_id"),
        "device_type", "region", "customer_type", "loyalty_flag", "channel",
    )


def _variant(user_id: Column, flipped: bool) -> Column:
    first, second = ("Variant", "Control") if flipped else ("Control", "Variant")
    return F.when((user_id * 7 + 3) % 10 < 5, F.lit(first)).otherwise(F.lit(second))


@memo_per_source
def raw_experiment_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _user_attrs(spark, sf_dir).select("user_id")
    primary = u.select(
        "user_id", F.lit(EXPERIMENT_NAME).alias("experiment_name"),
        _variant(F.col("user_id"), False).alias("variant"),
        _ts_ntz(PRIMARY_ASSIGNED_AT).alias("assigned_at"),
    )
    # A later re-assignment with the opposite variant for every 20th user.
    repeat = u.where(F.col("user_id") % 20 == 0).select(
        "user_id", F.lit(EXPERIMENT_NAME).alias("experiment_name"),
        _variant(F.col("user_id"), True).alias("variant"),
        _ts_ntz(REPEAT_ASSIGNED_AT).alias("assigned_at"),
    )
    return primary.unionByName(repeat)


@memo_per_source
def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The primary assignment is one row per user and exists for every user
    # that has events, so its variant is a function of user_id: no join needed.
    e = _events_with_dims(spark, sf_dir).where(F.col("event_name") == "payment_complete")
    return e.select(
        F.col("event_id").alias("order_id"), "session_id", "user_id",
        F.col("ts").alias("order_timestamp"),
        F.when(F.col("event_id") % 53 == 0, F.lit(0.0))
         .when(F.col("event_id") % 59 == 0, F.lit(-1.0))
         .otherwise(F.col("value")).alias("revenue"),
        (F.col("value") * 0.95).alias("basket_value"),
        (1 + F.col("k") % 24).alias("items_count"),
        "device_type", "region", "customer_type", "loyalty_flag", "channel",
        _variant(F.col("user_id"), False).alias("variant"),
    )


@memo_per_source
def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("base_price"),
        (F.lit(0.12) + (F.col("p_size") % 31) / F.lit(100.0)).alias("margin_rate"),
    )


RAW_BUILDERS = {
    "raw_users": raw_users,
    "raw_products": raw_products,
    "raw_sessions": raw_sessions,
    "raw_events": raw_events,
    "raw_orders": raw_orders,
    "raw_experiment_assignments": raw_experiment_assignments,
}


_LAZY_LOCK = __import__("threading").RLock()


class LazyFrames(dict):
    """name -> DataFrame mapping whose entries are built on first access, so
    a query that needs two tables never plans the other four."""

    def __init__(self, builders):
        super().__init__()
        self._builders = dict(builders)

    def __missing__(self, name):
        with _LAZY_LOCK:
            if dict.__contains__(self, name):
                return dict.__getitem__(self, name)
            df = self._builders[name]()
            self[name] = df
            return df

    def __contains__(self, name):
        return name in self._builders

    def keys(self):
        return self._builders.keys()

    def items(self):
        return [(k, self[k]) for k in self._builders]

    def values(self):
        return [self[k] for k in self._builders]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self):
        return len(self._builders)


def raw_entities(spark: SparkSession, sf_dir: str) -> LazyFrames:
    """All six raw entities as lazy DataFrames keyed like the raw CSV files."""
    return LazyFrames({k: functools.partial(fn, spark, sf_dir) for k, fn in RAW_BUILDERS.items()})


def write_documents(docs: DataFrame, folder: str) -> str:
    """The ``documents`` table as one ``.md`` file for each row, named by doc_id, in
    sub-folders of about ``FOLDER_FILES`` files: whoever lists one holds its files in
    memory. Returns the pattern of the sub-folders."""
    spark = docs.sparkSession
    folders = max(1, -(-docs.count() // FOLDER_FILES))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for i in range(folders):
        store.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i:05d}"))

    def write(batches):
        from zlib import crc32

        from pyarrow import fs
        store, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                name = f"doc-{doc_id:012d}.md"  # names its folder too, so that a doc_id has one file
                with store.open_output_stream(f"{at}/{crc32(name.encode()) % folders:05d}/{name}") as out:
                    out.write((text or "").encode())
        return iter(())
    docs.select("doc_id", "text").mapInPandas(write, "done int").write.format("noop").mode("overwrite").save()
    return f"{folder}/*"
