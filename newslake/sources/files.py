"""Small files and folders of any file system that Spark reaches; shared scratch folders."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from newslake.operators.checkpoints import checkpoint_folder


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole: beside its place first, then renamed."""
    p, fs = _path(spark, path)
    beside = _path(spark, f"{path}.{uuid.uuid4().hex}.part")[0]
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"{path} was not written")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the session's checkpoints, which all executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
