"""A keyed table in hash buckets, each a folder of its own, under versions.

A batch is read with the buckets that its keys fall in, and only these are
written anew; the next version's manifest names the new folders of those and the
old folders of all others, whose files stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .snapshots import Scratch, tidy
from .versions import StaleVersion, Versions, _files

_BUCKET = "_bucket"


class Buckets:
    """Rows by ``key`` in ``n`` buckets below ``path``; the number of buckets stays what the first version has."""

    def __init__(self, spark: SparkSession, path: str, key: str, n: int = 64):
        self.spark, self.key, self.versions = spark, key, Versions(spark, path)
        known = self.versions.list()
        self.n = self.versions.manifest(known[-1])["buckets"] if known else n

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int"))

    def _write(self, df: DataFrame, base: int | None, kept: list[dict]) -> int:
        folder = f"data/{uuid.uuid4().hex}"
        at = f"{self.versions.path}/{folder}"
        with tidy(self.spark):
            self._bucketed(df).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(at)
        parts: dict[int, list] = {}
        for name, size, _ in _files(self.spark, at):
            _, bucket, file = name.split("/")
            parts.setdefault(int(bucket.split("=")[1]), []).append([f"/{file}", size])
        new = [{"folder": f"{folder}/{_BUCKET}={k}", "files": files, "schema": df.schema.json(), "bucket": k} for k, files in sorted(parts.items())]
        if not new and not kept:  # a table without rows still has a schema
            df.limit(0).coalesce(1).write.parquet(f"{at}-none")
            files = [[name, size] for name, size, _ in _files(self.spark, f"{at}-none")]
            new = [{"folder": f"{folder}-none", "files": files, "schema": df.schema.json(), "bucket": -1}]
        version = (base or 0) + 1
        if (self.versions.list() or [0])[-1] != version - 1 or not self.versions._publish({"version": version, "base": base, "state": "", "buckets": self.n, "tables": {"rows": kept + new}}):
            raise StaleVersion(f"version {version} came first")
        return version

    def create(self, df: DataFrame) -> int:
        """The first version."""
        return self._write(df, None, [])

    def read(self, version: int | None = None) -> DataFrame:
        return self.versions.read("rows", version=version)

    def upsert(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """The next version: in the buckets that keys of ``batch`` fall in ``merge(old, new)``, and all others as they are.

        ``merge`` must keep rows in their bucket, as all merges by key do.
        """
        base = self.versions.list()[-1]
        parts = self.versions.manifest(base)["tables"]["rows"]
        batch = Scratch(self.spark, "batch").table(self._bucketed(batch), "rows")
        touched = {r[0] for r in batch.select(_BUCKET).distinct().collect()}  # at most the number of buckets
        old = [p for p in parts if p["bucket"] in touched]
        whole = self.read(base)
        schema = whole.schema
        rows = self.spark.read.schema(schema).parquet(*(f"{self.versions.path}/{p['folder']}" for p in old)) if old else whole.limit(0)
        return self._write(merge(rows, batch.drop(_BUCKET)).select(*schema.fieldNames()), base, [p for p in parts if p["bucket"] not in touched and p["bucket"] >= 0])
