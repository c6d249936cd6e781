"""Links within keyed runs of rows: rows that share a key are compared there, and a spanning forest of their links comes out.

A run is compared by one task, so runs are bounded.  A key of more weight than a
block is dealt to blocks, each of which also gets the key's first node.  Rows
that come to be in that node's component need no further comparison with
one another; the others, in blocks of their own, meet one another and all rows
of the key.  A great group of near copies, nearly all linked to any one of them,
therefore costs about what its rows do, and no pair goes uncompared unless it is
connected already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import Scratch, freeing

#: Gives the ends (positions in a run) of a forest's edges: rows, first row of the run, row after its last.
Forest = Callable[[pa.Table, int, int], tuple[list[int], list[int]]]


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of unsigned 64-bit hashes as a column of lists of longs."""
    ends = np.cumsum([0] + [len(x) for x in arrays]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def grown(count: int, near) -> tuple[list[int], list[int]]:
    """A spanning forest of ``count`` members, where ``near(u, rest)`` gives those of ``rest`` that are linked to ``u``."""
    free, a, b = np.ones(count, bool), [], []
    for s in range(count):
        if not free[s]:
            continue
        free[s], queue = False, [s]
        while queue:
            u = queue.pop()
            rest = np.flatnonzero(free)
            if not len(rest):
                return a, b
            found = near(u, rest)
            free[found] = False
            queue += found.tolist()
            a += [u] * len(found)
            b += found.tolist()
    return a, b


def similar_sets(numerator: int, denominator: int) -> Forest:
    """A forest of the rows whose sets ``hashes`` (sorted, not empty) have a Jaccard similarity of the fraction or more."""

    def forest(rows: pa.Table, s: int, e: int) -> tuple[list[int], list[int]]:
        sets = [np.asarray(x.values).view(np.uint64) for x in rows.column("hashes").slice(s, e - s)]
        n = np.array([len(x) for x in sets])

        def near(u: int, rest: np.ndarray) -> np.ndarray:
            rest = rest[np.minimum(n[rest], n[u]) * denominator >= np.maximum(n[rest], n[u]) * numerator]
            if not len(rest):
                return rest
            every = np.concatenate([sets[i] for i in rest])
            at = np.minimum(np.searchsorted(sets[u], every), n[u] - 1)
            both = np.add.reduceat((sets[u][at] == every).astype(np.int64), np.cumsum(n[rest]) - n[rest])
            return rest[both * denominator >= (n[rest] + n[u] - both) * numerator]

        return grown(e - s, near)

    return forest


def met(batches: Iterator[pa.RecordBatch], key: str = "cell") -> Iterator[pa.RecordBatch]:
    """The rows, sorted by ``key``, that share it with another row; of a run only its first row is ever held."""
    held: pa.RecordBatch | None = None  # a run's only row so far
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy(zero_copy_only=False)
        same = keys[1:] == keys[:-1]
        on = last is not None and keys[0] == last
        shared = np.concatenate([[on], same]) | np.concatenate([same, [False]])
        if on and held is not None:
            yield held
        last = keys[-1]
        if on or shared[-1]:
            held = None
        if not shared[-1]:
            held = b.slice(b.num_rows - 1)
        yield b.filter(pa.array(shared))


def edges(batches: Iterator[pa.RecordBatch], key: str, forest: Forest) -> Iterator[pa.RecordBatch]:
    """Edges of ``forest`` over each run of equal ``key`` in rows sorted by it; a run may span batches."""
    held: list[pa.RecordBatch] = []

    def solve(rows: pa.Table) -> pa.RecordBatch:
        node, keys = rows.column("node").to_numpy(), rows.column(key).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        pairs: set[tuple[int, int]] = set()
        for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
            s, e = int(cuts[k]), int(cuts[k + 1])
            a, b = forest(rows, s, e)
            pairs.update((min(x, y), max(x, y)) for x, y in zip(node[s:e][a].tolist(), node[s:e][b].tolist(), strict=True) if x != y)
        both = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        begin = int(np.searchsorted(keys, keys[-1], "left"))
        if begin or not held or held[-1].column(key)[-1].as_py() != keys[0]:
            yield solve(pa.Table.from_batches([*held, batch.slice(0, begin)]).combine_chunks())
            held = []
        held.append(batch.slice(begin))
    if held:
        yield solve(pa.Table.from_batches(held).combine_chunks())


def _forests(rows: DataFrame, key: str, forest: Forest) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(freeing(lambda b: edges(b, key, forest)), "a bigint, b bigint")


def linked(rows: DataFrame, key: str, forest: Forest, scratch: Scratch, name: str, block: int, weight: str | None = None) -> DataFrame:
    """Edges (``a``, ``b``) whose components are those of all links among rows (``key`` long, ``node`` long, …) that share a key.

    A run weighs about two ``block`` at most, by the number of rows or by the sum of ``weight``; a row that weighs
    more by itself is one of few.  ``forest`` links the rows of a run, and never a row with itself.
    """
    w = F.sum(weight) if weight else F.count("*")
    sizes = rows.groupBy(key).agg(w.alias("_w"), F.min("node").alias("_first")).where(F.col("_w") > block)
    big = scratch.table(sizes.select(key, "_first", F.ceil(F.col("_w") / block).cast("int").alias("_n")), f"{name}-big")
    if big.isEmpty():
        return _forests(rows, key, forest)
    columns, small = rows.columns, rows.join(big.select(key), key, "left_anti")
    great = rows.join(big, key)
    own = F.pmod(F.xxhash64("node"), F.col("_n")).cast("int")
    every = F.when(F.col("node") == F.col("_first"), F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array(own))
    unit = F.xxhash64(F.lit(1), F.col(key), F.col("_k"))
    spread = great.withColumn("_k", F.explode(every)).withColumn(key, unit).select(*columns)
    found = scratch.table(_forests(small.select(*columns).unionByName(spread), key, forest), f"{name}-first")
    roots = scratch.table(components(found, Scratch(scratch.spark, f"{name}-roots")), f"{name}-roots")
    # who isn't in the component of its key's first node
    firsts = big.join(roots.withColumnsRenamed({"node": "_first", "root": "_mass"}), "_first", "left").select(key, "_n", F.coalesce("_mass", "_first").alias("_mass"))
    great = rows.join(firsts, key).join(roots.withColumnRenamed("root", "_root"), "node", "left")
    great = great.withColumn("_rest", F.coalesce("_root", "node") != F.col("_mass"))
    rest = scratch.table(great.where("_rest").groupBy(key).agg(w.alias("_w")).select(key, F.ceil(F.col("_w") / block).cast("int").alias("_m")), f"{name}-rest")
    if rest.isEmpty():
        return found
    great = great.join(rest, key).withColumn("_k", F.when(F.col("_rest"), F.pmod(F.xxhash64("node"), F.col("_m"))).otherwise(F.col("_m") + own).cast("int"))
    # block i of the rest meets every block j from i on; the blocks from _m on don't meet one another
    partners = F.when(F.col("_rest"), F.sequence(F.lit(0), F.col("_m") + F.col("_n") - 1)).otherwise(F.sequence(F.lit(0), F.col("_m") - 1))
    unit = F.xxhash64(F.lit(2), F.col(key), F.least("_j", "_k"), F.greatest("_j", "_k"))
    crossed = great.withColumn("_j", F.explode(partners)).withColumn(key, unit).select(*columns)
    return found.unionByName(_forests(crossed, key, forest))
