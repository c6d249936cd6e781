"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item of m shingles lies in a document at containment t if at least t*m of
its shingles do, so at most m - t*m are missing.  The item's bottom-k MinHash
sketch (its k shingles of least hash) with k one more than that bound must have
a shingle in common with every such document: no pair is missed, whatever the
document's length.  Items are partitioned by size in powers of two, and each
partition has the sketch depth that its largest size asks for, so short items
have short sketches.  A document of any length is looked up by the hashes of
its shingles against the sketches, slice by slice, and what it hits is verified
by exact shingle containment.

Documents are scanned once for each block of items.  A block is bounded by
``block_bytes`` of item text and is what executors get by broadcast: the texts
and their sketches.  Of several blocks one is searched after another, each in a
job that writes what it found, and the next one's broadcast takes its place.
Exact shingles are made for the items that a document hits, so a large benchmark
takes more scans and no more memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .line_dedup import numbered
from .shared import Scratch, freeing, packed, ship, unpacked
from .shingles import CHUNK, shingles, slices, word_hashes

#: Beyond ASCII, what separates words: signs and spaces of Latin-1, general punctuation and symbols, ideographic and full-width punctuation.
_SEPARATOR = re.compile("[\u00a0-\u00bf\u00d7\u00f7\u2000-\u2bff\u3000-\u303f\uff00-\uff0f]")
_WORD = re.compile("[a-z0-9_\u0080-\U0010ffff]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789_", *range(0x80, 0x100)]] = True
WIDTH = 5


def normal(text: str | None) -> str:
    text = (text or "").lower()
    return text if text.isascii() else _SEPARATOR.sub(" ", text)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(normal(text))


def grams_of(text: str | None) -> set[tuple[str, ...]]:
    """The shingles of an item: runs of ``WIDTH`` words, or of all its words if these are fewer."""
    words = words_of(text)
    width = min(WIDTH, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


class Items:
    """Sketches and texts of a block of items (id, text, how many rows are so)."""

    def __init__(self, rows: list[tuple], least: Fraction = Fraction(4, 5)):
        self.least = least
        self.ids, self.texts, self.times, self.sizes, self.widths = [], [], [], [], []
        sketch: list[tuple[int, int]] = []
        for item_id, text, times in rows:
            grams = grams_of(text)
            if not grams:
                continue
            width = len(next(iter(grams)))
            size = 1 << (len(grams).bit_length())  # the partition holds size/2 to size - 1
            depth = size - 1 - -(-(size - 1) * least.numerator // least.denominator) + 1
            hashes = sorted({int(shingles(word_hashes(np.frombuffer(" ".join(g).encode(), np.uint8), _IS_WORD)[0], width)[0]) for g in grams})
            sketch += [(h, len(self.ids)) for h in hashes[:depth]]
            self.ids.append(item_id)
            self.texts.append(text)
            self.times.append(times)
            self.sizes.append(len(grams))
            self.widths.append(width)
        sketch.sort()
        self.hashes = np.array([h for h, _ in sketch], np.uint64)
        self.owner = np.array([k for _, k in sketch], np.int64)
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.used = sorted(set(self.widths))

    def _hit(self, grams: np.ndarray, place: np.ndarray) -> set[tuple[int, int]]:
        """(place, item) of the grams that are in a sketch."""
        maybe = np.flatnonzero(self.gate[(grams & np.uint64(0xFFFF)).astype(np.int64)])
        low = np.searchsorted(self.hashes, grams[maybe], "left")
        high = np.searchsorted(self.hashes, grams[maybe], "right")
        found: set[tuple[int, int]] = set()
        for k in np.flatnonzero(high > low).tolist():
            found.update((int(place[maybe[k]]), int(i)) for i in self.owner[low[k] : high[k]])
        return found

    def candidates(self, texts: list[str | None]) -> set[tuple[int, int]]:
        """(position of text, item) of all pairs whose sketch and shingles meet; short texts are hashed together."""
        out: set[tuple[int, int]] = set()
        some: list[bytes] = []
        at: list[int] = []
        held = 0

        def look(hashes: np.ndarray, doc: np.ndarray) -> None:
            for width in self.used:
                grams = shingles(hashes, width)
                inside = np.flatnonzero(doc[: len(grams)] == doc[width - 1 :]) if len(grams) else np.empty(0, np.int64)
                out.update(self._hit(grams[inside], doc[inside]))

        def flush() -> None:
            nonlocal held
            if some:
                begins = np.cumsum([0] + [len(x) + 1 for x in some[:-1]])
                hashes, start = word_hashes(np.frombuffer(b"\n".join(some), np.uint8), _IS_WORD)
                look(hashes, np.array(at)[np.searchsorted(begins, start, "right") - 1])
            some.clear()
            at.clear()
            held = 0

        for k, text in enumerate(texts):
            data = normal(text).encode("utf-8", "surrogatepass")
            if held + len(data) >= CHUNK:
                flush()
            if len(data) >= CHUNK:
                carried = np.empty(0, np.uint64)
                for part in slices(np.frombuffer(data, np.uint8), _IS_WORD):
                    carried = np.concatenate([carried, word_hashes(part, _IS_WORD)[0]])
                    look(carried, np.full(len(carried), k))
                    carried = carried[max(0, len(carried) - WIDTH + 1) :]
                continue
            some.append(data)
            at.append(k)
            held += len(data) + 1
        flush()
        return out

    def verify(self, text: str | None, items: list[int]) -> list[tuple[int, int]]:
        """(item, shared shingles) of those that reach the containment, exactly; memory follows the items' size."""
        left = {i: grams_of(self.texts[i]) for i in items}
        want: dict[tuple, list[int]] = {}
        for i in items:
            for g in left[i]:
                want.setdefault(g, []).append(i)
        widths, recent = sorted({self.widths[i] for i in items}), []
        for m in _WORD.finditer(normal(text)):
            recent.append(m[0])
            del recent[:-WIDTH]
            for w in widths:
                if len(recent) >= w and (g := tuple(recent[-w:])) in want:
                    for i in want.pop(g):
                        left[i].discard(g)
        shared = {i: self.sizes[i] - len(left[i]) for i in items}
        return [(i, n) for i, n in shared.items() if n * self.least.denominator >= self.least.numerator * self.sizes[i]]

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(position of text, item, shared shingles) of all contained items."""
        by: dict[int, list[int]] = {}
        for k, i in self.candidates(texts):
            by.setdefault(k, []).append(i)
        return [(k, i, n) for k in sorted(by) for i, n in self.verify(texts[k], sorted(by[k]))]


def blocks(benchmark: DataFrame, block_bytes: int = 32 << 20) -> tuple[int, Iterator[Items]]:
    """The items in blocks of about ``block_bytes`` of text: as many blocks as their total asks for, each item in one, repeated rows once with their number."""
    items = benchmark.where("text is not null").groupBy("item_id", "text").agg(F.count("*").alias("times"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    part = lambda k: items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
    return n, (Items([tuple(r) for r in part(k)]) for k in range(n))


def _searched(docs: DataFrame, benchmark: DataFrame, block_bytes: int, scratch: Scratch, search: Callable[[DataFrame, Broadcast], DataFrame]) -> DataFrame:
    """What ``search`` finds for all blocks: at once if there is one, and else written block after block."""
    n, every = blocks(benchmark, block_bytes)
    found = []
    for k, block in enumerate(every):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        here = search(docs, shared)
        if n == 1:
            return here
        found.append(scratch.table(here, f"block-{k}"))
        shared.unpersist()
    return reduce(DataFrame.unionByName, found)


def contained(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 32 << 20) -> DataFrame:
    """(``doc_id``, ``item_id``, ``n_shingles``, ``n_shared``, ``containment``) of all pairs at 0.8 or more.

    Shingles are distinct runs of 5 words of the lower-cased text; an item of
    fewer words is one shingle of all of them, and one without words (or null)
    is in no document.  Repeated rows give a pair each.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)

    def search(docs: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                for j in range(0, b.num_rows, 1024):
                    part = b.slice(j, 1024)
                    found = [x for x in items.search(part.column("text").to_pylist()) for _ in range(items.times[x[1]])]
                    size = [items.sizes[i] for _, i, _ in found]
                    n = [n for _, _, n in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array([k for k, _, _ in found], pa.int64())),
                            pa.array([items.ids[i] for _, i, _ in found], item_type),
                            pa.array(size, pa.int64()), pa.array(n, pa.int64()),
                            pa.array([a / s for a, s in zip(n, size, strict=True)], pa.float64()),
                        ],
                        ["doc_id", "item_id", "n_shingles", "n_shared", "containment"],
                    )

        return docs.select("doc_id", "text").mapInArrow(freeing(run), f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shingles bigint, n_shared bigint, containment double")

    return _searched(docs, benchmark, block_bytes, Scratch(spark, "contained"), search)


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 32 << 20, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that contain no item; all columns stay.

    With one block they are filtered as they are read.  With more, each block is
    a job of its own that writes the rows that go, and these are taken out in
    the end, by broadcast if they are counted to be few.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "clean")
    ship(spark)

    def clean(rows: DataFrame, shared: Broadcast, of: bool) -> DataFrame:
        """The rows that have none of a block's items, or those that have."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for j in range(0, b.num_rows, 1024):
                    part = b.slice(j, 1024)
                    keep = np.full(part.num_rows, of)
                    keep[[k for k, _, _ in shared.value.search(part.column("text").to_pylist())]] = not of
                    yield part.filter(pa.array(keep))

        return rows.mapInArrow(freeing(run), rows.schema)

    n, every = blocks(benchmark, block_bytes)
    if n == 1:
        return unpacked(clean(packed(docs, "text"), spark.sparkContext.broadcast(next(every)), True), docs.columns, ("text",))
    rows = numbered(packed(docs, "doc_id", "text"), scratch)
    few = lambda _, shared: clean(rows.select("_doc", "text"), shared, False).select("_doc")
    gone = scratch.table(_searched(docs, benchmark, block_bytes, scratch, few).distinct(), "gone")
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return unpacked(rows.join(gone, "_doc", "left_anti"), docs.columns, ("doc_id", "text"))


SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(regexp_replace(lower(text), '[\x{a0}-\x{bf}\x{d7}\x{f7}\x{2000}-\x{2bff}\x{3000}-\x{303f}\x{ff00}-\x{ff0f}]', ' ', 'g'), '[a-z0-9_\x{80}-\x{10ffff}]+') AS words FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(regexp_replace(lower(text), '[\x{a0}-\x{bf}\x{d7}\x{f7}\x{2000}-\x{2bff}\x{3000}-\x{303f}\x{ff00}-\x{ff0f}]', ' ', 'g'), '[a-z0-9_\x{80}-\x{10ffff}]+') FROM benchmark
), v AS (
  SELECT DISTINCT least(5, len(words)) AS width FROM w WHERE side = 'b' AND len(words) > 0
), i AS (
  SELECT side, id, words, width, unnest(range(1, len(words) - width + 2)) AS k FROM w JOIN v ON side = 'd' OR width = least(5, len(words))
), s AS (
  SELECT DISTINCT side, id, width, array_to_string(words[k:k+width-1], ' ') AS shingle FROM i
), n AS (
  SELECT id, count(*) AS n FROM s WHERE side = 'b' GROUP BY id
), pairs AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared
  FROM s d JOIN s b ON d.shingle = b.shingle AND d.width = b.width AND d.side = 'd' AND b.side = 'b' GROUP BY d.id, b.id
)
SELECT doc_id, item_id, n AS n_shingles, shared AS n_shared, shared / n AS containment
FROM pairs JOIN n ON item_id = id WHERE shared * 5 >= n * 4
"""


def op9(spark, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
