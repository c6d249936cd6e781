"""SimHash near-duplicates: segment-popcount embedding and a grid range join.

A 64-bit fingerprint is cut in two halves and each half in sixteen 2-bit
segments.  The popcounts of the segments embed a half in a 16-dimensional
integer grid where Manhattan distance never exceeds Hamming distance.
Fingerprints at 4 or fewer differing bits have a half at 2 or fewer, so the
embedded halves lie at Manhattan distance 2 or less, and two such grid points
always have a grid point at distance 1 or less from both.  Every fingerprint
therefore enters the grid cells at distance 0 and 1 around its point (at most
33 a half) and the join on cells misses no link.  Each candidate is verified by
the exact Hamming distance.

Within a cell only a spanning forest of the verified links is emitted, so a
group of thousands of near copies gives thousands of edges rather than
millions, and connectivity is exact: components of the union of the forests
are the components of all links.  Popcounts alone get less selective as
fingerprints get more, so a cell of more than ``block`` members is divided by
the bits themselves: of five parts of the word a link leaves one as it is, so
members meet again in the five cells that a part's bits name, 2^12 times finer.
A cell that is greater even then is split in blocks, and every pair of blocks
is a task unit of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .line_dedup import numbered
from .shared import Scratch, freeing, packed, ship, unpacked

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CHUNK = 1 << 15


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, most significant first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    whole = len(bits) // 128 * 128
    small = bits[:whole].reshape(-1, 128, 64).sum(axis=1, dtype=np.uint8)  # 128 at most: fits
    return small.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """Signed 64-bit SimHash of the word shingles of one whole text, in bounded memory.

    A text of fewer words than ``width`` has one shingle, the whole sequence;
    a null text or one without words has fingerprint 0.
    """
    data = _lowered(text)
    words = _WORD.findall(data)
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        some = [digest(line[a:b], 42) for a, b in zip(first[k : k + CHUNK], last[k : k + CHUNK], strict=True)]
        counts += _bit_counts(np.array(some, np.uint64))
    return int(np.packbits(counts * 2 > n).view(">u8")[0].astype(np.uint64).view(np.int64))


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(``doc_id``, ``fp`` signed long) for every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), width) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(freeing(run), f"doc_id {kind}, fp bigint")


def cells(fps: DataFrame) -> DataFrame:
    """(``cell``, ``fp``) for the cells within distance 1 of the two embedded halves of each ``fp``.

    A cell packs sixteen popcounts of 0..2 in 2 bits each, and above them the half.
    """
    halves = F.array(
        F.struct(F.lit(0).cast("long").alias("half"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("bits")),
        F.struct(F.lit(1).cast("long").alias("half"), F.shiftrightunsigned("fp", 32).alias("bits")),
    )
    even = F.lit(0x55555555)
    packed = fps.select("fp", F.explode(halves).alias("p")).select(
        "fp", "p.half", (F.col("p.bits").bitwiseAND(even) + F.shiftrightunsigned("p.bits", 1).bitwiseAND(even)).alias("at")
    )
    steps = []
    for d in range(16):
        here = F.shiftright("at", 2 * d).bitwiseAND(F.lit(3))
        steps += [F.when(here < 2, F.col("at") + F.lit(1 << 2 * d)), F.when(here > 0, F.col("at") - F.lit(1 << 2 * d))]
    around = F.array_compact(F.array(F.col("at"), *steps))
    return packed.select("fp", "half", F.explode(around).alias("at")).select(
        F.shiftleft("half", 33).bitwiseOR(F.col("at")).alias("cell"), "fp"
    )


def _forest(left: np.ndarray, right: np.ndarray | None, bits: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within ``left``, or between ``left`` and ``right`` too.

    ``left`` grows one tree after another from a frontier, so the work is one
    distance row for each member and never a stored matrix.
    """
    nodes = left if right is None else np.concatenate([left, right])
    free = np.ones(len(nodes), bool)
    a: list[int] = []
    b: list[int] = []
    for s in range(len(nodes)):
        if not free[s]:
            continue
        free[s] = False
        queue = [s]
        while queue:
            u = queue.pop()
            rest = np.flatnonzero(free)
            if not len(rest):
                break
            near = rest[np.bitwise_count(nodes[rest] ^ nodes[u]) <= bits]
            free[near] = False
            queue += near.tolist()
            a += [int(nodes[u])] * len(near)
            b += nodes[near].tolist()
    return a, b


def _runs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Forests of the runs of equal ``cell`` in rows sorted by it; a run may span batches."""
    kept_cell, kept_fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def solve(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(cell)]])
        size = ends - starts
        u = fp.view(np.uint64)
        two = starts[size == 2]
        ok = two[np.bitwise_count(u[two] ^ u[two + 1]) <= bits]
        a, b = [fp[ok]], [fp[ok + 1]]
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            x, y = _forest(u[s:e], None, bits)
            a.append(np.array(x, np.uint64).view(np.int64))
            b.append(np.array(y, np.uint64).view(np.int64))
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        cell = np.concatenate([kept_cell, batch.column("cell").to_numpy(zero_copy_only=False)])
        fp = np.concatenate([kept_fp, batch.column("fp").to_numpy(zero_copy_only=False)])
        if not len(cell):
            continue
        last = int(np.searchsorted(cell, cell[-1], "left"))
        kept_cell, kept_fp = cell[last:], fp[last:]
        if last:
            yield solve(cell[:last], fp[:last])
    if len(kept_cell):
        yield solve(kept_cell, kept_fp)


def _finer(at: DataFrame, bits: int) -> DataFrame:
    """The members of cells dealt to a cell for each of ``bits + 1`` parts of the word, by that part's bits."""
    cuts = [64 * k // (bits + 1) for k in range(bits + 2)]
    part = [F.xxhash64("cell", F.lit(k), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << z - a) - 1))) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return at.select(F.explode(F.array(*part)).alias("cell"), "fp")


def _blocks(at: DataFrame, big: DataFrame, block: int) -> DataFrame:
    """The members of big cells dealt to a cell for each pair of blocks: the unit (least, greatest) holds the members of both."""
    rows = at.join(big, "cell").withColumn("n", F.ceil(F.col("count") / block).cast("int")).withColumn("k", F.pmod(F.xxhash64("fp"), F.col("n")))
    pair = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.least(j.cast("long"), F.col("k")).alias("i"), F.greatest(j.cast("long"), F.col("k")).alias("j")))
    return rows.select("cell", "fp", F.explode(pair).alias("p")).select(F.xxhash64("cell", "p.i", "p.j").alias("cell"), "fp")


def links(fps: DataFrame, scratch: Scratch, bits: int = 4, block: int = 2048) -> DataFrame:
    """Edges (``a``, ``b``) between distinct fingerprints whose components are those of all links.

    ``bits`` may be at most 4: the grid's distances follow from it.
    """
    if not 0 <= bits <= 4:
        raise ValueError("bits must be 0 to 4")
    at = cells(fps)
    found = []
    big = scratch.table(at.groupBy("cell").count().where(F.col("count") > block), "big")
    if not big.isEmpty():
        finer = scratch.table(_finer(at.join(big, "cell", "left_semi"), bits), "finer")
        most = scratch.table(finer.groupBy("cell").count().where(F.col("count") > block), "most")
        found += [finer.join(most, "cell", "left_anti"), _blocks(finer, most, block)]
        at = at.join(big, "cell", "left_anti")
    found.append(at.select("cell", "fp"))
    parts = [
        x.repartition("cell").sortWithinPartitions("cell").mapInArrow(freeing(lambda b: _runs(b, bits)), "a bigint, b bigint") for x in found
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def near_duplicates(docs: DataFrame, bits: int = 4, width: int = 4) -> DataFrame:
    """(``doc_id``, ``fingerprint``, ``component_id``) for every row of ``docs``.

    ``component_id`` is the least ``doc_id`` that can be reached over links.
    Null and wordless texts have fingerprint zero and are linked like any
    other; a null ``doc_id`` keeps its row and never is a component's name
    unless all ids of the component are null.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    all_fps = scratch.table(fingerprints(docs, width), "fps")
    one = scratch.table(all_fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "one")
    edges = links(one.select("fp"), scratch, bits)
    roots = components(edges, scratch)
    names = one.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = scratch.table(names, "names")
    least = names.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = scratch.table(names.join(least, "root").select("fp", "component_id"), "labels")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return all_fps.join(labels, "fp").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame, bits: int = 4, width: int = 4, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that stay when each group keeps its first row, that of the least ``doc_id``.

    Rows count by themselves, whether their ids are null (these come first) or
    repeated.  The rows that go are broadcast up to ``broadcast_rows`` of them,
    counted first, so that texts aren't shuffled; beyond that the join is by shuffle.
    """
    columns, scratch = docs.columns, Scratch(docs.sparkSession, "simhash-keep")
    docs = numbered(packed(docs, "doc_id", "text"), scratch)
    found = near_duplicates(docs.select(F.col("_doc").alias("doc_id"), "text"), bits, width)
    gone = scratch.table(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_doc")), "gone")
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return unpacked(docs.join(gone, "_doc", "left_anti"), columns, ("doc_id", "text"))


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
