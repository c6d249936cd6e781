"""Near copies by Jaccard similarity of word shingles: SimHash grid, prefix filter and gate, exact verification.

A text is the set of its runs of 5 words.  Two sets of similarity 0.8 or more
share 0.8 of the larger one at least, so under any common order of all shingles
they share one of the first n - ceil(0.8 n) + 1 of each.  The order is that of
the hashes, after which come the shingles that a sample shows to be frequent;
the sample decides about the work and never about the result.

Texts whose first 64 bits of SimHash lie within 4 are met by the popcount grid of
:mod:`simhash`; the prefix filter finds the others, beyond the grid's radius.  Those
that share a shingle of the prefix, have sizes in the ratio and SimHashes of 256 bits
within 90 are joined to coarse groups with them.  At a similarity of exactly 0.8
39 to 48 bits differ, and the chance of more than 90 is below 1e-8.  Of unrelated
texts one pair in about 700,000 passes, so coarse groups stay those of near
copies when cells grow with the corpus.  Inside the coarse
groups every pair is compared by its whole sets, but for those that are joined
already; components of these links are the result.  Shingles are compared by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import links, simhash
from .components import components
from .line_dedup import numbered
from .shared import Scratch, freeing, packed, ship, unpacked
from .shingles import mix, other, shingles, slices, word_hashes
from .simhash import _bit_counts, _lowered

WIDTH = 5
GATE = 90
_PRINTS = ("f1", "f2", "f3", "f4")
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text; one of fewer words than ``width`` is one shingle."""
    parts = [word_hashes(x, _IS_WORD)[0] for x in slices(np.frombuffer(_lowered(text), np.uint8), _IS_WORD)]
    words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return np.unique(shingles(words, min(width, len(words)))) if len(words) else words


def _fingerprint(s: np.ndarray) -> list[int]:
    out = []
    for _ in _PRINTS:
        out.append(int(np.packbits(_bit_counts(s) * 2 > len(s)).view(">u8")[0].astype(np.uint64).view(np.int64)))
        s = other(s, 1)
    return out


def frequent(docs: DataFrame, scratch: Scratch, sample: int = 20_000, least: int = 20, most: int = 1_000_000) -> np.ndarray:
    """Hashes of shingles in ``least`` or more of about ``sample`` documents, the ``most`` frequent of them."""
    n = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                sets = [shingle_set(t) for t in b.column("text").slice(k, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], ["h"])

    some = docs.where(F.pmod(F.xxhash64("_doc"), F.lit(1_000_000)) < F.lit(sample * 1_000_000 // max(n, sample)))
    found = some.select("text").mapInArrow(freeing(run), "h bigint").groupBy("h").count().where(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(most)
    return np.sort(np.array([r.h for r in found.select("h").collect()], np.int64).view(np.uint64))


def sketches(docs: DataFrame, often: np.ndarray) -> DataFrame:
    """(``_doc``, ``node`` digest of the set, ``n`` shingles, ``f1`` to ``f4`` SimHash, ``prefix``) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                node, size, fps, prefix = [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingle_set(text)
                    late = np.isin(s, heavy, assume_unique=True)
                    node.append(int(mix(np.array([other(s, 0).sum(dtype=np.uint64)]))[0].view(np.int64)))
                    size.append(len(s))
                    fps.append(_fingerprint(s))
                    prefix.append(np.concatenate([s[~late], s[late]])[: len(s) - -(-4 * len(s) // 5) + 1])
                f = np.array(fps, np.int64).reshape(-1, len(_PRINTS))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_doc"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), *(pa.array(x) for x in f.T.copy()), links.lists(prefix)],
                    ["_doc", "node", "n", *_PRINTS, "prefix"],
                )

    kind = docs.schema["_doc"].dataType.simpleString()
    return docs.select("_doc", "text").mapInArrow(freeing(run), f"_doc {kind}, node bigint, n bigint, {', '.join(f'{f} bigint' for f in _PRINTS)}, prefix array<bigint>")


def _coarse(rows: pa.Table, s: int, e: int) -> tuple[list[int], list[int]]:
    n, *prints = (rows.column(c).slice(s, e - s).to_numpy().astype(np.uint64, copy=False) for c in ("n", *_PRINTS))

    def near(u: int, rest: np.ndarray) -> np.ndarray:
        m = n[rest]
        rest = rest[np.minimum(m, n[u]) * 5 >= np.maximum(m, n[u]) * 4]
        return rest[sum(np.bitwise_count(f[rest] ^ f[u]).astype(np.int64) for f in prints) <= GATE]

    return links.grown(e - s, near)


def _by_grid(one: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (``a``, ``b``) between nodes whose first prints lie within the grid's 4 bits."""
    first = scratch.table(one.groupBy("f1").agg(F.min("node").alias("rep")), "prints")
    end = lambda c: first.select(F.col("f1").alias(c), F.col("rep").alias(f"_{c}"))
    found = simhash.links(first.select(F.col("f1").alias("fp")), scratch).join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return found.unionByName(one.join(first, "f1").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")))


def labels(docs: DataFrame, scratch: Scratch, block: int = 4096, set_block: int = 1 << 20, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(``_doc``, ``least`` of its group) for every row of ``docs`` (``_doc``, ``text``); wordless texts are one group.

    ``block`` bounds the rows of a cell that are compared at a time, ``set_block`` the hashes of a coarse group's sets.
    """
    ship(docs.sparkSession)
    seen = scratch.table(sketches(docs, frequent(docs, scratch)), "sketches")
    one = scratch.table(seen.groupBy("node").agg(F.min("_doc").alias("_doc"), *(F.first(c).alias(c) for c in ("n", *_PRINTS))), "one")
    copies = scratch.table(seen.select("_doc", "node").join(one.select("node", F.col("_doc").alias("first")), "node").where("_doc <> first").select("_doc"), "copies")
    if copies.count() <= broadcast_rows:
        copies = F.broadcast(copies)
    cells = seen.join(copies, "_doc", "left_anti").select(F.explode("prefix").alias("cell"), "node")
    cells = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(freeing(links.met), "cell bigint, node bigint")
    cells = scratch.table(scratch.table(cells, "met").join(one.drop("_doc"), "node"), "cells")
    scratch.drop("met")
    near = links.linked(cells, "cell", _coarse, scratch, "cells", block)
    coarse = components(near.unionByName(_by_grid(one, scratch)), scratch)
    scratch.drop("cells")
    group = scratch.table(one.join(coarse, "node").select("_doc", "node", "n", F.col("root").alias("grp")), "coarse")

    if group.count() <= broadcast_rows:
        group = F.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                hashes = links.lists([shingle_set(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("grp", "node", "n")), hashes], ["grp", "node", "n", "hashes"])

    sets = docs.join(group, "_doc").select("grp", "node", "n", "text").mapInArrow(freeing(run), "grp bigint, node bigint, n bigint, hashes array<bigint>")
    exact = Scratch(docs.sparkSession, "near-exact")
    roots = components(links.linked(scratch.table(sets, "sets"), "grp", links.similar_sets(4, 5), scratch, "groups", set_block, "n"), exact)
    names = scratch.table(one.join(roots, "node", "left").select("node", "_doc", F.coalesce("root", "node").alias("root")), "names")
    least = names.groupBy("root").agg(F.min("_doc").alias("least"))
    return seen.select("_doc", "node").join(names.join(least, "root").select("node", "least"), "node").select("_doc", "least")


def keep_one(docs: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near copies keeps its first row, that of the least ``doc_id``.

    Rows count by themselves, whether their ids are null or repeated.  Lists of
    rows are broadcast up to ``broadcast_rows``, counted first, so that texts
    aren't shuffled; beyond that the joins are by shuffle.
    """
    columns, scratch = docs.columns, Scratch(docs.sparkSession, "near")
    docs = numbered(packed(docs, "doc_id", "text"), scratch)
    gone = scratch.table(labels(docs.select("_doc", "text"), scratch, broadcast_rows=broadcast_rows).where(F.col("_doc") != F.col("least")).select("_doc"), "gone")
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return unpacked(docs.join(gone, "_doc", "left_anti"), columns, ("doc_id", "text"))
