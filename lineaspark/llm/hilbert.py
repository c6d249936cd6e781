"""Sharding along a Hilbert curve over metadata.

Language, source and text size are each quantised to ``bits`` bits and the
three cell numbers give a position on a 3-dimensional Hilbert curve, so rows
that are near on the curve are near in every dimension.  Rows are sorted by
curve position and cut into runs of equal counts (law ``rows``): each file then
covers a small box of the metadata space, and its column statistics prune.

The global order never passes through one task: rows are range-partitioned and
sorted, and a row's rank is its number in its partition plus the sizes of the
partitions before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .line_dedup import numbered
from .shared import Scratch, packed, ship, unpacked


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the curve of points (rows of ``cells``, one column a dimension) on a grid of 2^bits a side.

    Works from the finest rotation outwards: undo the excess rotations and
    reflections of each level, Gray-code over the dimensions, and interleave.
    """
    x = np.array(cells, np.int64).T.copy()
    dims = len(x)
    q = 1 << bits - 1
    while q > 1:
        low = q - 1
        for i in range(dims):
            far = (x[i] & q) != 0
            swap = np.where(far, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(far, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << bits - 1
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | x[i] >> b & 1
    return out


def _named(c: Column, bits: int) -> Column:
    """A cell for a name; null has cell 0."""
    return F.coalesce(F.pmod(F.xxhash64(F.lit(3), c), F.lit(1 << bits)), F.lit(0)).cast("int") if bits else F.lit(0)


def curve(docs: DataFrame, size: Column, bits: int = 6) -> DataFrame:
    """``docs`` with ``_curve``; sizes are cut at the ``2^bits`` approximate quantiles of all rows."""
    ship(docs.sparkSession)
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = sorted(set(docs.agg(F.percentile_approx(size, shares, 1000).alias("q")).first()["q"] or []))
    names = [docs[c] if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")]

    @F.pandas_udf("bigint")
    def at(n: pd.Series, lang: pd.Series, source: pd.Series) -> pd.Series:
        grid = np.stack([np.searchsorted(cuts, n.to_numpy(), "right") if cuts else np.zeros(len(n), np.int64), lang.to_numpy(), source.to_numpy()], 1)
        return pd.Series(hilbert_index(grid, bits))

    cell = [F.when(c.isNull(), F.lit(0)).otherwise(_named(c, bits)) for c in names]
    return docs.withColumn("_curve", at(size, *cell))


def assign(docs: DataFrame, shards: int = 8, bits: int = 6, key: str | None = None) -> DataFrame:
    """(``doc_id``, ``size``, ``text_crc32``, ``curve``, ``shard``, ``slot``) for every row.

    Counts of any two shards differ by one at most; ``slot`` numbers a shard's
    rows from 0 in curve order.  Ties on the curve are in order of ``doc_id``,
    then digest; rows that agree in all of these are alike.  ``lang`` and
    ``source`` may be null or missing; a null text has no bytes.  A ``key``
    column, if named, breaks the last ties and is returned as well.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "hilbert")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    names = [c for c in ("lang", "source") if c in docs.columns]
    more = [key] if key else []
    rows = scratch.table(docs.select("doc_id", *more, *names, (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32")), "rows")
    rows = curve(rows, F.col("size"), bits).select("doc_id", *more, "size", "text_crc32", F.col("_curve").alias("curve"))
    keys = ["curve", "doc_id", "text_crc32", "size", *more]
    row = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = scratch.table(ordered.select("*", F.shiftright(row, 33).alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "ordered")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.col("before") + F.col("row")
    out = ordered.join(F.broadcast(sizes), "part").withColumn("rank", rank)
    out = out.withColumn("shard", F.expr(f"cast((rank * {shards}) div total as int)"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return out.select("doc_id", *more, "size", "text_crc32", "curve", "shard", (F.col("rank") - first).alias("slot"))


def write(docs: DataFrame, path: str, shards: int = 8, bits: int = 6) -> None:
    """Write ``docs`` as one folder a shard, rows in curve order within files; ids may be null or repeated."""
    columns, own = docs.columns, ("doc_id", "text", "lang", "source")
    docs = numbered(packed(docs, *own), Scratch(docs.sparkSession, "hilbert-write"))
    places = assign(docs, shards, bits, "_doc").select(F.col("_doc").alias("_key"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = docs.join(places, F.col("_doc").eqNullSafe(F.col("_key"))).repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    unpacked(rows, columns, own, F.col("_shard").alias("shard_no")).write.partitionBy("shard_no").parquet(path)


def op6(spark, sf_dir: str) -> DataFrame:
    found = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
