"""SparkSession construction and cluster-shared paths."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins/partition counts from
# runtime statistics (broadcast only when the measured side is small,
# skew-join splitting for hot keys, coalescing of tiny shuffle partitions).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app_name: str = "shopmetrics",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Local/test session builder. On a cluster, pass the master via spark-submit."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if master and master.startswith("local"):
        # Local mode: the driver JVM is the only executor.
        conf["spark.driver.memory"] = os.environ.get("SHOPMETRICS_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def app_key(spark: SparkSession) -> str:
    """Identity of the session (cache key for shared plans): application id
    plus the session object, so DataFrames are never shared across sessions."""
    try:
        return f"{spark.sparkContext.applicationId}-{id(spark):x}"
    except Exception:  # noqa: BLE001 -- sessions without a local SparkContext
        return f"session-{id(spark):x}"


_LOCAL_CKPT: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Only when it is unset (local tests) a private
    scratch folder is created and registered on the SparkContext."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001
        sc = None
    current = None
    if sc is not None:
        current = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return (sc.getCheckpointDir() if sc is not None else None) or current
    master = sc.master if sc is not None else ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    key = app_key(spark)
    if key not in _LOCAL_CKPT:
        _LOCAL_CKPT[key] = tempfile.mkdtemp(prefix="shopmetrics-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        if sc is not None:
            sc.setCheckpointDir(_LOCAL_CKPT[key])
    return (sc.getCheckpointDir() if sc is not None else None) or _LOCAL_CKPT[key]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub folder of the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in a folder of its own below the shared one: for an
    intermediate that several branches of a plan read, each with other columns and
    filters. A lost executor costs a re-read."""
    path = shared_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
