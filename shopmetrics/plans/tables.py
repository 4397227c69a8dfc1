"""K1: named tables that are replaced as a whole.

A rebuild writes every table to a folder of a new version and registers it under a
name of its own; one pointer file then says which version of each table is the
current one, and is replaced by one rename. Until that rename readers, and a later
run after one that was killed half-way, have the old version of every table; after
it the new one. ``refresh`` points the catalog's names (views ``<database>.<table>``)
at what the pointer file says, also in a session that has not written any of it.

Layout: sessions and orders are bucketed by session, so that the joins and sums on
the session need no exchange; events are partitioned by date. With the writes some
measures are observed (rows, missing values), and kept beside the table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import files

#: Layout of the stored tables: bucket column, or the timestamp whose date partitions.
BUCKETED = {"raw_sessions": "session_id", "raw_orders": "session_id", "clean_sessions": "session_id", "clean_orders": "session_id"}
BY_DATE = {"raw_events": "event_timestamp", "clean_events": "event_timestamp"}
DATE = "stored_date"
#: Columns whose missing values are counted while a table is written.
COUNTED = {"raw_events": ("event_id", "event_timestamp"), "clean_events": ("event_id", "event_timestamp")}


class Tables:
    """The tables of one root folder, under one database of the session's catalog."""

    def __init__(self, spark: SparkSession, root: str, database: str):
        self.spark, self.root, self.database = spark, root.rstrip("/"), database
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{self.root}/catalog'")

    # ------------------------------------------------------------------ pointer
    @property
    def _pointer(self) -> str:
        return f"{self.root}/CURRENT.json"

    def current(self) -> dict:
        """{table: {version, path, columns, ...}} as last committed."""
        text = files.read_small(self.spark, self._pointer)
        return json.loads(text) if text else {}

    def commit(self, written: Mapping[str, dict]) -> None:
        """Make ``written`` the current version of its tables, in one step."""
        before = self.current()
        files.write_small(self.spark, self._pointer, json.dumps({**before, **written}))
        self.refresh()
        self._forget({t: x for t, x in before.items() if t in written})

    def _forget(self, old: Mapping[str, dict]) -> None:
        """Remove versions that the one now replaced had replaced: a query that
        reads the version before can end."""
        kept = {x["path"] for x in self.current().values()} | {x["path"] for x in old.values()}
        for table in old:
            for version in files.names(self.spark, f"{self.root}/{table}"):
                if f"{self.root}/{table}/{version}" not in kept:
                    self.spark.sql(f"DROP TABLE IF EXISTS `{self.database}`.`{table}__{version}`")
                    files.remove(self.spark, f"{self.root}/{table}/{version}")

    # ------------------------------------------------------------------ writing
    def write(self, table: str, df: DataFrame) -> dict:
        """Write a new version of ``table``, which nobody sees before ``commit``."""
        version = uuid.uuid4().hex[:16]
        path, columns = f"{self.root}/{table}/{version}", df.columns
        observed = Observation(f"{table}-{version}")
        counts = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in COUNTED.get(table, ())]
        out = df.observe(observed, F.count(F.lit(1)).alias("rows"), *counts)
        entry = {"version": version, "path": path, "columns": columns, "buckets": None, "by_date": table in BY_DATE}
        if table in BUCKETED:
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            entry["buckets"] = [BUCKETED[table], buckets]
            writer = out.repartition(buckets, BUCKETED[table]).write.bucketBy(buckets, BUCKETED[table]).sortBy(BUCKETED[table])
        elif table in BY_DATE:
            # Rows of a date come together, and large dates are split again.
            out = out.withColumn(DATE, F.to_date(BY_DATE[table])).hint("rebalance", DATE)
            writer = out.write.partitionBy(DATE)
        else:
            writer = out.write
        writer.format("parquet").option("path", path).saveAsTable(f"`{self.database}`.`{table}__{version}`")
        entry["schema"] = self.spark.table(f"`{self.database}`.`{table}__{version}`").schema.json()
        entry["measures"] = observed.get
        return entry

    def rebuild(self, layers: list[tuple[str, Callable[[Mapping[str, DataFrame]], Mapping[str, DataFrame]]]]) -> list[str]:
        """Replace every table of ``layers`` together: each layer is made from the
        new version of those before, and all become current at once."""
        written, seen = {}, {}
        for _, make in layers:
            for table, df in make(seen).items():
                written[table] = self.write(table, df)
                seen[table] = self._frame(table, written[table])
        self.commit(written)
        return list(written)

    # ------------------------------------------------------------------ reading
    def _frame(self, table: str, entry: dict) -> DataFrame:
        return self.spark.table(f"`{self.database}`.`{table}__{entry['version']}`").select(*entry["columns"])

    def refresh(self) -> list[str]:
        """Point the catalog's names at the current versions; returns the names."""
        now = self.current()
        for table, entry in now.items():
            stored = f"`{self.database}`.`{table}__{entry['version']}`"
            if not self.spark.catalog.tableExists(f"{self.database}.{table}__{entry['version']}"):
                self._attach(stored, entry)
            columns = ", ".join(f"`{c}`" for c in entry["columns"])
            self.spark.sql(f"CREATE OR REPLACE VIEW `{self.database}`.`{table}` AS SELECT {columns} FROM {stored}")
        return list(now)

    def _attach(self, stored: str, entry: dict) -> None:
        ddl = self.spark._jvm.org.apache.spark.sql.types.DataType.fromJson(entry["schema"]).toDDL()
        layout = ""
        if entry["by_date"]:
            layout = f" PARTITIONED BY ({DATE})"
        elif entry["buckets"]:
            by, n = entry["buckets"]
            layout = f" CLUSTERED BY (`{by}`) SORTED BY (`{by}`) INTO {n} BUCKETS"
        self.spark.sql(f"CREATE TABLE {stored} ({ddl}) USING parquet{layout} LOCATION '{entry['path']}'")
        if entry["by_date"]:
            self.spark.sql(f"ALTER TABLE {stored} RECOVER PARTITIONS")

    def __getitem__(self, table: str) -> DataFrame:
        return self.spark.table(f"`{self.database}`.`{table}`")

    def on_dates(self, table: str, first: str, last: str) -> DataFrame:
        """Rows of a table by date whose date is from ``first`` to ``last``; only
        those partitions are read."""
        entry = self.current()[table]
        stored = self.spark.table(f"`{self.database}`.`{table}__{entry['version']}`")
        return stored.where(F.col(DATE).between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select(*entry["columns"])

    def measures(self, table: str) -> dict:
        """What was observed while the current version was written."""
        return self.current()[table]["measures"]
