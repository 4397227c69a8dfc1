"""Files of the shared storage through the cluster's own file systems: what the
jobs need beside Spark's readers and writers (listing, one atomic rename, small
pointer files, removal)."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, at: str) -> bool:
    path, fs = _path(spark, at)
    return fs.exists(path)


def remove(spark: SparkSession, at: str) -> None:
    path, fs = _path(spark, at)
    fs.delete(path, True)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename ``source`` to ``target`` in one step, over a file that is there."""
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    path, fs = _path(spark, target)
    fs.mkdirs(path.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(_path(spark, source)[0], path, options)


def write_small(spark: SparkSession, at: str, text: str) -> None:
    """A small file, whole or not at all: written beside and renamed."""
    beside = f"{at}.{uuid.uuid4().hex}.tmp"
    path, fs = _path(spark, beside)
    out = fs.create(path, True)
    out.write(bytearray(text.encode()))
    out.close()
    replace(spark, beside, at)


def read_small(spark: SparkSession, at: str) -> str | None:
    path, fs = _path(spark, at)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _path(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """URIs of the folders that ``pattern`` names (one, if it is a plain path)."""
    path, fs = _path(spark, pattern)
    return [f.getPath().toUri().toString() for f in fs.globStatus(path) or [] if f.isDirectory()]


def state(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files at ``paths`` (files or folders): names, lengths and
    times of change. A changed, added or removed file changes it."""
    found = []
    for at in paths:
        path, fs = _path(spark, at)
        if not fs.exists(path):
            continue
        top = fs.getFileStatus(path)
        for f in (fs.listStatus(path) if top.isDirectory() else [top]):
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()
