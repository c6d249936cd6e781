"""Shared folder and written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    ``spark.checkpoint.dir`` of the session, else the checkpoint folder set on
    the context.  Where neither is set a temporary folder is set, which is only
    right (and only allowed) in local mode.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lineaspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Spark's setting by which the shuffle files of a statement go when it ends, rather than when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is written in this block leaves no shuffle files: its table is read from now on, and they never are."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


_passing: list[list["Scratch"]] = []


@contextmanager
def passing() -> Iterator[None]:
    """Tables of a :class:`Scratch` that is made in this block are removed at its end: by then something that stays must have been written of them."""
    _passing.append([])
    try:
        yield
    finally:
        for s in _passing.pop():
            s.drop()


class Scratch:
    """Tables of one run of one operator, below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        if _passing:
            _passing[-1].append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write a frame and read it back: its lineage ends here."""
        path = f"{self.base}/{name}"
        with tidy(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)  # digests as text are half as large by it
        return self.spark.read.schema(df.schema).parquet(path)

    def partitioned(self, df: DataFrame, name: str, by: list[str]) -> dict[tuple, str]:
        """Write a frame in a folder for each value of integer columns ``by``; gives the folders by value."""
        path = f"{self.base}/{name}"
        with tidy(self.spark):
            df.repartition(*by, F.pmod(F.xxhash64(*(c for c in df.columns if c not in by)), F.lit(int(self.spark.conf.get("spark.sql.shuffle.partitions"))))).write.mode("overwrite").partitionBy(*by).parquet(path)
        found = {}
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(path + "/" + "/".join(f"{c}=*" for c in by)))
        for f in files or []:
            at = f.getPath().toString()
            found[tuple(int(x.split("=")[1]) for x in at.split("/")[-len(by) :])] = at
        return found

    def drop(self, name: str = "") -> None:
        """Remove a table that nothing reads any more, or all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
