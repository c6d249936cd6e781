"""Versioned snapshots: immutable folders of files, and a manifest a version that names them.

A commit writes its tables to folders of their own and then publishes a
manifest, a small file that appears in one step under the version's number
or not at all.  Readers name a version, or take the latest, and read what its
manifest names; nothing that is published ever changes, so a reader that keeps
its version sees no later write.  A manifest also has the state of what the
snapshot was made from, so that one made from tables that have changed since
isn't mistaken for one made from them as they are.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

from .snapshots import tidy


class StaleVersion(RuntimeError):
    """Another commit came first."""


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name below ``path``, bytes, time) of all files with data, sorted."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(at).toString().rstrip("/")
    found, out = fs.listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString()
        if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
            out.append((name.removeprefix(base), f.getLen(), f.getModificationTime()))
    return sorted(out)


def state_of(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files below the paths: it changes when a table does."""
    return hashlib.sha256(json.dumps([_files(spark, p) for p in paths]).encode()).hexdigest()


class Versions:
    """The versions of some tables, below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def list(self) -> list[int]:
        """The numbers of all versions, from 1."""
        at = self._at("versions")
        fs = at.getFileSystem(self._conf)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version is made of, or the latest one; a version that isn't there is an error."""
        known = self.list()
        if not known or version not in (None, *known):
            raise ValueError(f"no version {version} in {self.path}" if version else f"no version in {self.path}")
        at = self._at(f"versions/{version or known[-1]:020d}.json")
        stream = at.getFileSystem(self._conf).open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def find(self, state: str) -> int | None:
        """The latest version made from this state."""
        return next((v for v in reversed(self.list()) if self.manifest(v)["state"] == state), None)

    def commit(self, tables: dict[str, DataFrame], state: str = "", base: int | None = None, sorted_by: dict[str, str] | None = None) -> int:
        """Write ``tables`` and publish them as a version; gives its number.

        A table that ``sorted_by`` names a column for is written in files of ranges
        of it, with Bloom filters, so that one value is looked up in one row group.

        With ``base`` they are added to the tables of that version, which must
        be the latest: else, and if another commit is published meanwhile, the
        error is :class:`StaleVersion` and nothing was published.  Without it the
        version has just these tables.
        """
        folder = f"data/{uuid.uuid4().hex}"
        parts = {k: list(v) for k, v in self.manifest(base)["tables"].items()} if base else {}
        for name, df in tables.items():
            by = (sorted_by or {}).get(name)
            writer = df.repartitionByRange(by).sortWithinPartitions(by).write.option(f"parquet.bloom.filter.enabled#{by}", "true") if by else df.write
            with tidy(self.spark):
                writer.parquet(f"{self.path}/{folder}/{name}")
            files = [[n, size] for n, size, _ in _files(self.spark, f"{self.path}/{folder}/{name}")]
            parts.setdefault(name, []).append({"folder": f"{folder}/{name}", "files": files, "schema": df.schema.json()})
        while True:
            latest = max(self.list(), default=0)
            if base and latest != base:
                raise StaleVersion(f"version {latest} came after {base}")
            if self._publish({"version": latest + 1, "base": base, "state": state, "tables": parts}):
                return latest + 1
            if base:
                raise StaleVersion(f"version {base + 1} came first")

    def _publish(self, manifest: dict) -> bool:
        """Whether the manifest got its version's place, which it takes in one step."""
        draft, place = self._at(f"drafts/{uuid.uuid4().hex}"), self._at(f"versions/{manifest['version']:020d}.json")
        fs = draft.getFileSystem(self._conf)
        fs.mkdirs(place.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._fs.FileContext.getFileContext(fs.makeQualified(place).toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(place), none)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def read(self, name: str, schema: T.StructType | None = None, version: int | None = None) -> DataFrame:
        """A table as of a version, or of the latest, with the schema that it was written with if none is given; files that are no more as the manifest has them are an error."""
        parts = self.manifest(version)["tables"][name]
        for p in parts:
            if [[n, size] for n, size, _ in _files(self.spark, f"{self.path}/{p['folder']}")] != p["files"]:
                raise ValueError(f"{p['folder']} isn't what was published")
        schema = schema or T.StructType.fromJson(json.loads(parts[0]["schema"]))
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p['folder']}" for p in parts))
