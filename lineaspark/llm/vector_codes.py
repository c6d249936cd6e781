"""Compression of vectors to one byte a part, by codebooks that are trained here, with VA-file filtering.

A vector is cut into 16 equal consecutive parts and each part is written as the
number of the nearest of up to 64 entries.  All arithmetic is on integers, so
codes, errors and codebooks don't depend on partitions or on the order of rows.

The search for the nearest entry works as a VA-file does.  Each coordinate of a
codebook's entries is quantised to a cell of a few bits, and a cell knows the
least and the greatest coordinate in it.  For each query and coordinate a table
has the least and the greatest squared difference to every cell, so two look-ups
a coordinate bound the distance to an entry from below and from above.  Only
entries whose lower bound doesn't exceed the least upper bound are compared by
integer distances; of equal ones the lower index wins.

Training passes over the rows of a folder; the driver holds codebooks only,
which have 64 entries of a vector's length at most.  A task sums what it
assigned and sends one row an entry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import Scratch, freeing, ship

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Bits of a cell, and rows that are compared at a time.
CELL_BITS = 4
ROWS = 2048


@dataclass(frozen=True)
class Codebooks:
    """Integer ``entries`` by part, entry and position, and the greatest size of a component (see :func:`limit`)."""

    entries: np.ndarray
    most: int

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of all components as decimal text, in order, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def restored(self, codes: np.ndarray) -> np.ndarray:
        """The integer vectors that rows of entry numbers stand for."""
        parts = self.entries.shape[0]
        return self.entries[np.arange(parts), codes].reshape(len(codes), -1)


def limit(length: int) -> int:
    """Components beyond this are taken as this, so that squared distances of ``length`` of them fit in 62 bits."""
    return math.isqrt((1 << 62) // max(1, length)) // 2


class Cells:
    """The entries of one part as a VA-file: cells of their coordinates, and the range of each cell."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries
        n, width = entries.shape
        low, high = (entries.min(axis=0), entries.max(axis=0)) if n else (np.zeros(width, np.int64),) * 2
        step = (high - low >> bits) + 1
        self.cell = (entries - low) // step  # of each entry and coordinate
        self.least = np.full((width, 1 << bits), np.iinfo(np.int64).max)
        self.greatest = np.full((width, 1 << bits), np.iinfo(np.int64).min)
        for d in range(width):
            np.minimum.at(self.least[d], self.cell[:, d], entries[:, d])
            np.maximum.at(self.greatest[d], self.cell[:, d], entries[:, d])
        empty = self.least > self.greatest  # cells of no entry are never looked up
        self.least[empty] = self.greatest[empty] = 0

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the squared distance of each row of ``x`` to each entry."""
        low = np.zeros((len(x), len(self.entries)), np.int64)
        high = np.zeros_like(low)
        for d in range(x.shape[1]):
            below, above = self.least[d] - x[:, d, None], x[:, d, None] - self.greatest[d]
            gap = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            low += (gap * gap)[:, self.cell[:, d]]
            high += (far * far)[:, self.cell[:, d]]
        return low, high

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest entry to each row of ``x``, ties to the lower index."""
        low, high = self.bounds(x)
        row, entry = np.nonzero(low <= high.min(axis=1, keepdims=True))  # by row, then entry; no row is without
        apart = x[row] - self.entries[entry]
        distance = (apart * apart).sum(axis=1)
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
        least = np.minimum.reduceat(distance, starts) if len(starts) else distance
        hit = np.flatnonzero(distance == least[row])
        first = hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])] if len(hit) else hit
        return entry[first], distance[first]


def integers(vectors: pa.Array, length: int, most: int) -> np.ndarray:
    """Rows of ``length`` integers, floor(256 x) of each component; shorter vectors end in zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.clip(np.floor(flat * SCALE), -most, most).astype(np.int64)
    out = np.zeros((len(vectors), length), np.int64)
    if len(flat):
        row = np.repeat(np.arange(len(vectors)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def kept(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite; never null."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The codebooks that the first ``entries`` rows by ``vec_id`` (ties by the vector, null ids last) start."""
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    length = -(-longest // parts) * parts
    most = limit(length)
    some = rows.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).toArrow()
    x = integers(some.column("embedding").combine_chunks(), length, most) if some.num_rows else np.zeros((0, length), np.int64)
    return Codebooks(np.ascontiguousarray(x.reshape(len(x), parts, length // parts).swapaxes(0, 1)), most)


def _batches(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their integer vectors, cut into parts."""
    parts, _, width = books.entries.shape
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            part = b.slice(k, ROWS)
            yield part, integers(part.column("embedding"), books.length, books.most).reshape(part.num_rows, parts, width)


def trained(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, and each entry becomes the floor of the mean of what it got."""
    parts, n, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(e) for e in books.entries]
        sums, counts = np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
        for _, x in _batches(batches, books):
            for p in range(parts):
                entry, _ = cells[p].nearest(x[:, p])
                np.add.at(sums[p], entry, x[:, p])
                counts[p] += np.bincount(entry, minlength=n)
        p, e = np.nonzero(counts)
        for k in range(0, len(p), 1024):
            at = (p[k : k + 1024], e[k : k + 1024])
            total = pa.ListArray.from_arrays(pa.array(np.arange(len(at[0]) + 1, dtype=np.int32) * width), pa.array(sums[at].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(at[0] * n + at[1]), pa.array(counts[at]), total], ["entry", "n", "sums"])

    got = rows.select("embedding").mapInArrow(freeing(run), "entry bigint, n bigint, sums array<bigint>")
    wide = "decimal(38,0)"  # exact, however many rows there are
    sums = got.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k].cast(wide)).alias(f"s{k}") for k in range(width)))
    after = books.entries.copy().reshape(parts * n, width)
    for r in sums.collect():  # one row an entry at most
        after[r.entry] = [int(r[f"s{k}"]) // r.n for k in range(width)]
    return Codebooks(after.reshape(parts, n, width), books.most)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of all ``rows`` (``vec_id``, ``embedding``), none of which :func:`kept` would drop."""
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds if books.entries.size else 0):
        books = trained(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks, *carry: str) -> DataFrame:
    """(the columns ``carry``, ``code`` of two hex digits a part, ``error``: the squared distance of the vector to what its code stands for)."""
    hexed = np.array([f"{k:02x}" for k in range(max(1, books.entries.shape[1]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(e) for e in books.entries]
        for b, x in _batches(batches, books):
            found = [cells[p].nearest(x[:, p]) for p in range(len(cells))]
            codes = hexed[np.stack([e for e, _ in found], axis=1)]
            code = ["".join(c) for c in codes.tolist()]
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(code, pa.string()), pa.array(error, pa.int64())], [*carry, "code", "error"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry]
    return rows.select(*carry, "embedding").mapInArrow(freeing(run), ", ".join([*kinds, "code string", "error bigint"]))


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, broadcast_rows: int = 100_000) -> tuple[DataFrame, Codebooks]:
    """((``vec_id``, ``label``, ``code``, ``error``, ``label_error``) of every kept row, the codebooks).

    A vector that is null or has a component that is null or not finite is
    dropped; an empty one is a vector of zeros, and shorter ones end in zeros,
    as all do if the length is no multiple of ``parts``.  Repeated and null
    ``vec_id`` are rows like others.  ``label_error`` is the sum of errors over
    all rows of the label, nulls being a label.  An empty table gives no rows
    and empty codebooks.  Other columns are ignored.
    """
    spark = embeddings.sparkSession
    ship(spark)
    rows = embeddings.select("vec_id", "embedding", "label").where(kept(F.col("embedding")))
    books = fit(rows, parts, entries, rounds)
    scratch = Scratch(spark, "codes")
    if not books.entries.shape[1]:
        codes = scratch.table(rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), "codes")
    else:
        codes = scratch.table(encode(rows, books, "vec_id", "label"), "codes")
    sums = scratch.table(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "labels")
    if sums.count() <= broadcast_rows:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "label", "code", "error", "label_error"), books


_DISTANCE = "list_sum(list_transform(range(1, CAST(len(x) + 1 AS BIGINT)), lambda k: (x[k] - c[k]) * (x[k] - c[k])))"


def _round(k: int) -> str:
    """CTEs: every part's nearest entry by the codebooks ``c{k}``, and the codebooks after that."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, part, x, entry, CAST({_DISTANCE} AS BIGINT) AS d FROM v JOIN c{k} USING (part) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1
), m{k} AS (
  SELECT part, entry, list(mean ORDER BY pos) AS c FROM (
    SELECT part, entry, pos, CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS mean FROM (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM a{k}) GROUP BY part, entry, pos
  ) GROUP BY part, entry
), c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (part, entry))"""


#: Of vectors of one length, a multiple of 16, and distinct ids, as the tables have them.
SQL = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), v AS MATERIALIZED (
  SELECT vec_id, part, x[part * len(x) // 16 + 1 : (part + 1) * len(x) // 16] AS x FROM k, range(16) t(part)
), first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 64
), c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM v JOIN first USING (vec_id)), {_round(0)}, {_round(1)},
last AS MATERIALIZED (
  SELECT vec_id, part, entry, CAST({_DISTANCE} AS BIGINT) AS d FROM v JOIN c2 USING (part) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1
), codes AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256
FROM codes JOIN k USING (vec_id)
"""


def op12(spark, sf_dir: str) -> DataFrame:
    rows, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
