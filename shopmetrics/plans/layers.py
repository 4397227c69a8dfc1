"""Layer plans: raw -> Silver -> Gold as lazy DataFrames, and their
materialisation (K1) as named tables."""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession

from ..operators.gold import gold_tables
from ..operators.silver import silver_tables
from ..session import app_key, shared_dir
from ..sources.fixtures import LazyFrames, raw_entities, source_state
from .tables import Tables

_LAYERS: dict[tuple, tuple[str, dict[str, LazyFrames]]] = {}
_BUILD_LOCK = threading.RLock()


def shop_tables(spark: SparkSession, sf_dir: str, name: str = "shop") -> Tables:
    """The stored tables of one source folder, in a database of their own."""
    tag = hashlib.sha1(f"{app_key(spark)} {sf_dir.rstrip('/')}".encode()).hexdigest()[:10]
    return Tables(spark, shared_dir(spark, f"{name}-{tag}"), f"{name}_{tag}")


def _layers(spark: SparkSession, sf_dir: str) -> dict[str, LazyFrames]:
    """Silver and Gold as stored tables, each written when it is first asked for
    and again when the source files have changed."""
    key, state = (app_key(spark), sf_dir.rstrip("/")), source_state(spark, sf_dir)
    with _BUILD_LOCK:
        known = _LAYERS.get(key)
        if known and known[0] == state:
            return known[1]
        tables = shop_tables(spark, sf_dir)
        silver = silver_tables(raw_entities(spark, sf_dir))

        def stored(lazy, name: str) -> DataFrame:
            with _BUILD_LOCK:  # one writer per table even if queries run in threads
                tables.commit({name: tables.write(name, lazy[name])})
                return tables[name]
        clean = LazyFrames({n: (lambda n=n: stored(silver, n)) for n in silver.keys()})
        gold = LazyFrames({n: (lambda n=n: stored(gold_tables(clean), n)) for n in GOLD})
        _LAYERS[key] = state, {"silver": clean, "gold": gold}
        return _LAYERS[key][1]


GOLD = ("gold_daily_kpis", "gold_funnel_metrics", "gold_experiment_results", "gold_segment_performance", "gold_product_performance")


def clean_tables(spark: SparkSession, sf_dir: str, materialized: bool = True) -> dict[str, DataFrame]:
    """Silver tables derived from the driver's parquet tables.

    ``materialized`` (default): like the shop's own Silver layer, each clean
    table is stored under the shared checkpoint folder (``spark.checkpoint.dir``)
    the first time a query needs it, and read back from there -- the lineage to the
    raw tables is cut and every later query starts from compact clean files, until
    the source files change. Otherwise the tables are lazy plans over the raw tables."""
    if not materialized:
        return silver_tables(raw_entities(spark, sf_dir))
    return _layers(spark, sf_dir)["silver"]


def stored_measures(spark: SparkSession, sf_dir: str, table: str) -> dict:
    """What was observed while the Silver table was written (it is, if it was not yet)."""
    clean_tables(spark, sf_dir)[table]
    return shop_tables(spark, sf_dir).measures(table)


def gold_layer(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Gold marts over the stored Silver layer, each written on first use and read
    back -- the marts the metric queries read, as the shop's own metric queries
    read its Gold tables."""
    return _layers(spark, sf_dir)["gold"]


def rebuild_layers(spark: SparkSession, sf_dir: str, tables: Tables) -> list[str]:
    """K1: Bronze (fixture adapter) -> Silver -> Gold, all 17 tables replaced
    together; each layer is read back from the tables of the one before."""
    return tables.rebuild([("bronze", lambda _: raw_entities(spark, sf_dir)), ("silver", silver_tables), ("gold", gold_tables)])
