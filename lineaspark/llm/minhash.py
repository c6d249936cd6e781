"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full sets.

A text is the set of its runs of two words.  Its signature has 100 symbols of 16
bits, each from the least of the set's hashes under a function of its own; two
sets of similarity s differ in a symbol with probability 1 - s.

The signature is split in 20 chunks of 5 symbols.  Signatures that differ in 39
symbols or fewer differ in one symbol at most in one of the chunks, by the
pigeonhole principle.  The one error that a chunk may have is enumerated: for each
of its symbols the other four make a cell.  So all pairs under the distance of 39
share one of their 100 cells, and no other pairs are looked at.  In a cell pairs
pass that differ in 39 or fewer of the symbols' lowest two bits, which no pair
under the distance fails.  At a similarity of exactly 0.8 the chance that all
chunks have more errors, or that the bits differ in more, is below 2e-9, and less
above.

Pairs that pass are joined to coarse groups, and within these every pair is
compared by its full sets of 64-bit shingle hashes, but for those that are joined
already.  Texts of equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import links
from .components import components
from .line_dedup import numbered
from .near_copies import shingle_set
from .shared import Scratch, freeing, ship
from .shingles import mix, other

WIDTH = 2
CHUNKS, SYMBOLS = 20, 5
LENGTH = CHUNKS * SYMBOLS
#: Signatures under this distance always share a cell: below two errors a chunk.
DISTANCE = 2 * CHUNKS - 1
#: Jaccard similarity from which sets are linked, as a fraction.
SIMILARITY = (80, 100)
#: Rows of a cell, and hashes of a coarse group, that one block has.
CELL_BLOCK, SET_BLOCK = 4096, 1 << 20

_ODD = mix(np.arange(1, LENGTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_TAG = mix(np.arange(1, LENGTH + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).reshape(SYMBOLS, CHUNKS)
_PAIRS = np.uint64(0x5555555555555555)


def signature(s: np.ndarray) -> np.ndarray:
    """``LENGTH`` symbols of 16 bits of a set that isn't empty, its hashes taken some at a time."""
    least = np.full(LENGTH, np.iinfo(np.uint64).max)
    for k in range(0, len(s), 1024):
        np.minimum(least, (s[k : k + 1024, None] * _ODD).min(axis=0), out=least)
    return mix(least).astype(np.uint16)


def cells(symbols: np.ndarray) -> np.ndarray:
    """The ``LENGTH`` cells of each row of symbols: those of a chunk but one, for each chunk and symbol left out."""
    chunks = symbols.reshape(len(symbols), CHUNKS, SYMBOLS)
    out = [mix(np.ascontiguousarray(np.delete(chunks, k, axis=2)).view(np.uint64)[:, :, 0] + _TAG[k]) for k in range(SYMBOLS)]
    return np.concatenate(out, axis=1)


def low_bits(symbols: np.ndarray) -> np.ndarray:
    """The lowest two bits of each symbol, 32 symbols to a word."""
    two = np.zeros((len(symbols), -(-LENGTH // 32) * 32), np.uint64)
    two[:, :LENGTH] = symbols & 3
    return np.bitwise_or.reduce(two.reshape(len(symbols), -1, 32) << (2 * np.arange(32, dtype=np.uint64)), axis=2)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many symbols words of :func:`low_bits` differ."""
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1)) & _PAIRS).sum(axis=-1, dtype=np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(``_doc``, the set's 128-bit digest ``h1``, ``h2``, its size ``n``, ``signature`` and its ``bits``, null of an empty set) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                h1, h2, size, signed, bits = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingle_set(text, WIDTH)
                    sums = np.array([other(s, 0).sum(dtype=np.uint64), other(s, 1).sum(dtype=np.uint64)])
                    h1.append(sums[0])
                    h2.append(sums[1])
                    size.append(len(s))
                    symbols = signature(s) if len(s) else None
                    signed.append(None if symbols is None else symbols.tobytes())
                    bits.append(None if symbols is None else low_bits(symbols[None]).tobytes())
                digest = [pa.array(mix(np.array(h, np.uint64)).view(np.int64)) for h in (h1, h2)]
                found = [part.column("_doc"), *digest, pa.array(size, pa.int64()), pa.array(signed, pa.binary()), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(found, ["_doc", "h1", "h2", "n", "signature", "bits"])

    kind = docs.schema["_doc"].dataType.simpleString()
    return docs.select("_doc", "text").mapInArrow(freeing(run), f"_doc {kind}, h1 bigint, h2 bigint, n bigint, signature binary, bits binary")


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, LENGTH)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(``cell``, ``node``) for each cell of each row."""
    for b in batches:
        for k in range(0, b.num_rows, 1024):
            part = b.slice(k, 1024)
            node = np.repeat(part.column("node").to_numpy(), LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(cells(_symbols(part.column("signature"))).ravel().view(np.int64)), pa.array(node)], ["cell", "node"])


def _gate(rows: pa.Table, s: int, e: int) -> tuple[list[int], list[int]]:
    """A forest of the rows of a cell within the distance and of sizes in the ratio."""
    n, bits = rows.column("n").slice(s, e - s).to_numpy(), np.frombuffer(b"".join(rows.column("bits").slice(s, e - s).to_pylist()), np.uint64).reshape(e - s, -1)
    part, whole = SIMILARITY

    def near(u: int, rest: np.ndarray) -> np.ndarray:
        rest = rest[np.minimum(n[rest], n[u]) * whole >= np.maximum(n[rest], n[u]) * part]
        return rest[distance(bits[rest], bits[u]) <= DISTANCE]

    return links.grown(e - s, near)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            hashes = links.lists([shingle_set(t, WIDTH) for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("grp", "node", "n")), hashes], ["grp", "node", "n", "hashes"])


def groups(docs: DataFrame, scratch: Scratch, cell_block: int = CELL_BLOCK, set_block: int = SET_BLOCK, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(``_doc``, ``n``, ``group``) for every row of ``docs`` (``_doc``, ``text``); a row without words has no group."""
    ship(docs.sparkSession)
    seen = scratch.table(sketches(docs), "sketches")
    one = seen.where("n > 0").groupBy("h1", "h2").agg(F.min("_doc").alias("_doc"), *(F.first(c).alias(c) for c in ("n", "signature", "bits")))
    one = scratch.table(one.withColumn("node", F.monotonically_increasing_id()), "one")
    dealt = one.select("node", "signature").mapInArrow(freeing(_dealt), "cell bigint, node bigint").repartition("cell").sortWithinPartitions("cell")
    met = scratch.table(dealt.mapInArrow(freeing(links.met), "cell bigint, node bigint"), "met")
    near = links.linked(met.join(one.select("node", "n", "bits"), "node"), "cell", _gate, scratch, "cells", cell_block)
    coarse = components(near, scratch)
    group = scratch.table(one.join(coarse, "node").select("_doc", "node", "n", F.col("root").alias("grp")), "coarse")
    if group.count() <= broadcast_rows:
        group = F.broadcast(group)
    sets = scratch.table(docs.join(group, "_doc").select("grp", "node", "n", "text").mapInArrow(freeing(_sets), "grp bigint, node bigint, n bigint, hashes array<bigint>"), "sets")
    exact = links.linked(sets, "grp", links.similar_sets(*SIMILARITY), scratch, "groups", set_block, "n")
    roots = components(exact, Scratch(docs.sparkSession, "minhash-exact"))
    names = one.join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("group"))
    return seen.select("_doc", "h1", "h2", "n").join(names, ["h1", "h2"], "left").select("_doc", "n", "group")


def near_duplicates(docs: DataFrame, cell_block: int = CELL_BLOCK, set_block: int = SET_BLOCK) -> DataFrame:
    """(``doc_id``, ``n_shingles``, ``component_id``, ``kept``) for every row of ``docs``.

    ``component_id`` is the least ``doc_id`` that links reach, the row's own
    included, and a row is kept if that is its ``doc_id``.  A row without words, or of a null text,
    has an empty set and its own id.  Null ids are never the least
    unless all of a group are; then its rows, of null ``component_id``, are kept.  Rows that
    repeat an id are rows of their own.  Other columns are ignored; an empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = groups(numbered(docs.select("doc_id", "text"), scratch), scratch, cell_block, set_block)
    rows = scratch.table(rows.select(F.col("_doc.doc_id").alias("doc_id"), "n", "group"), "grouped")
    least = rows.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "group", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT r, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS g FROM d WHERE len(w) > 0
), n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r
), l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY x.r, y.r) JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * i >= 80 * (p.n + q.n - i)
), reach AS (SELECT r, r AS other FROM d UNION SELECT reach.r, b FROM reach JOIN l ON a = other
), c AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON other = d.r GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""


def op13(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
