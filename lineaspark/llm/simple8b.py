"""Token ids in Simple-8b files.

A word of 64 bits holds a selector in its top four bits and, below it, a run
of ids of equal width, the first lowest.  Ids are cut in blocks of ``BLOCK``,
each packed on its own (its last word may be part empty), and a file's footer
has the first word of each block, so blocks are decoded independently and the
words of all blocks at once.  Selector 15 is an escape: the next word is one
whole id of more than 60 bits.

File: words; then block starts (unsigned 64-bit, one more than blocks); then
for each document its id (signed 64-bit), a null flag (a byte) and its number
of ids (unsigned 64-bit); then words, blocks, ids and documents (unsigned
64-bit) and the magic ``S8B1``.  All little-endian.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .pieces import encoder
from .shared import Scratch, freeing, ship

BLOCK = 256
MAGIC = b"S8B1"
PARTS = 400_000  # parts whose ids a worker keeps
#: Fixed values of the coding: ids a word and their width, by selector from 1.
PACK = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
COUNT = np.array([0, *(n for n, _ in PACK), 1], np.int64)
WIDTH = np.array([0, *(b for _, b in PACK), 0], np.uint64)


_SMALL = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bit lengths."""
    if ids.max() < 1 << 16:
        return _SMALL[ids]
    high = (ids >> np.uint64(32)).astype(np.float64)
    low = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block and the end; greedy: the most ids that fit, word by word."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    blocks = -(-n // BLOCK)
    width = np.zeros((blocks, BLOCK + 60), np.uint8)  # what lies past a block's end fits anywhere
    flat = np.zeros(blocks * BLOCK, np.uint8)
    flat[:n] = _widths(ids)
    width[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    most = int(width.max())
    choice = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    for s in range(len(PACK), 0, -1):
        count, bits = PACK[s - 1]
        if most <= bits:
            choice[:] = s
            continue
        wide = np.zeros((blocks, BLOCK + 61), np.int16)
        np.cumsum(width > bits, axis=1, dtype=np.int16, out=wide[:, 1:])
        choice[wide[:, count : count + BLOCK] == wide[:, :BLOCK]] = s
    # walk all blocks at once from word to word
    starts = np.zeros((blocks, BLOCK), bool)
    size = np.full(blocks, BLOCK, np.int64)
    size[-1] = n - (blocks - 1) * BLOCK
    row, at = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(row):
        starts[row, at] = True
        at = at + COUNT[choice[row, at]]
        left = at < size[row]
        row, at = row[left], at[left]
    first = np.flatnonzero(starts.reshape(-1)[: blocks * BLOCK])
    selector = choice.reshape(-1)[first].astype(np.uint64)
    of = np.cumsum(starts.reshape(-1)[:n]) - 1
    shift = (np.arange(n) - first[of]).astype(np.uint64) * WIDTH[selector][of]
    escaped = selector == ESCAPE
    body = np.where(escaped[of], np.uint64(0), ids << shift)
    words = np.bitwise_or.reduceat(body, first) | selector << np.uint64(60)
    place = np.arange(len(words)) + np.concatenate([[0], np.cumsum(escaped)[:-1]])
    out = np.zeros(len(words) + int(escaped.sum()), np.uint64)
    out[place] = words
    out[place[escaped] + 1] = ids[first[escaped]]
    starts_at = place[np.searchsorted(first, np.arange(blocks) * BLOCK)]
    return out, np.concatenate([starts_at, [len(out)]]).astype(np.int64)


def unpack(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of whole blocks; ``starts`` as given by :func:`pack`."""
    if not n:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    like = np.flatnonzero(selector == ESCAPE)
    if len(like):  # in a run of such words every second one is a whole id
        head = np.concatenate([[True], np.diff(like) != 1])
        begin = like[np.maximum.accumulate(np.where(head, np.arange(len(like)), 0))]
        real = like[(like - begin) % 2 == 0]
        raw[real + 1] = True
    at = np.flatnonzero(~raw)
    selector = selector[at]
    count = COUNT[selector]
    # the last word of a block has what is left of the block
    blocks = len(starts) - 1
    last = np.searchsorted(at, starts[1:]) - 1
    size = np.full(blocks, BLOCK, np.int64)
    size[-1] = n - (blocks - 1) * BLOCK
    total = np.concatenate([[0], np.cumsum(count)])
    begins = np.searchsorted(at, starts[:-1])
    count[last] = size - (total[last] - total[begins])
    to = np.cumsum(count) - count
    out = np.empty(n, np.uint64)
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[to[mine]] = words[at[mine] + 1]
            continue
        word, k = words[at[mine]], np.arange(COUNT[s])
        value = word[:, None] >> (k.astype(np.uint64) * WIDTH[s]) & np.uint64((1 << int(WIDTH[s])) - 1)
        place = to[mine][:, None] + k
        ok = k < count[mine][:, None]
        out[place[ok]] = value[ok]
    return out


class Writer:
    """One file, written block by block; memory holds one run of ids and the footer."""

    def __init__(self, uri: str):
        self.uri = uri
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(path.rsplit("/", 1)[0])
        self.out = fs.open_output_stream(path)
        self.rest = np.empty(0, np.uint32)
        self.starts = [np.zeros(1, np.int64)]
        self.words = self.ids = 0
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []

    def _pack(self, ids: np.ndarray) -> None:
        words, starts = pack(ids)
        self.out.write(words.astype("<u8").tobytes())
        self.starts.append(starts[1:] + self.words)
        self.words += len(words)

    def add(self, doc_ids: list[int | None], ids: list[bytes], kind: str = "<u4") -> None:
        """``ids`` of each document, as integers of ``kind``."""
        self.doc_ids += doc_ids
        wide = np.dtype(kind).itemsize
        self.sizes += [len(x) // wide for x in ids]
        held = np.concatenate([self.rest, np.frombuffer(b"".join(ids), kind)])
        whole = len(held) // BLOCK * BLOCK
        self.ids += len(held) - len(self.rest)
        for k in range(0, whole, 4096 * BLOCK):
            self._pack(held[k : min(whole, k + 4096 * BLOCK)])
        self.rest = held[whole:].copy()

    def close(self) -> None:
        if len(self.rest):
            self._pack(self.rest)
        starts = np.concatenate(self.starts)
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        foot = np.array([self.words, len(starts) - 1, self.ids, len(ids)], "<u8")
        for part in (starts.astype("<u8"), ids, null, np.array(self.sizes, "<u8"), foot):
            self.out.write(part.tobytes())
        self.out.write(MAGIC)
        self.out.close()


class Reader:
    """Documents of one file, a bounded run of ids at a time."""

    def __init__(self, uri: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(36, size - 36)
        if tail[32:] != MAGIC:
            raise ValueError(f"{uri} is not a Simple-8b file")
        self.words, self.blocks, self.ids, docs = (int(x) for x in np.frombuffer(tail[:32], "<u8"))
        at = self.words * 8
        take = lambda n, kind: np.frombuffer(self.file.read_at(n * np.dtype(kind).itemsize, at), kind)
        self.starts = take(self.blocks + 1, "<u8").astype(np.int64)
        at += 8 * (self.blocks + 1)
        self.doc_ids = take(docs, "<i8")
        at += 8 * docs
        self.null = take(docs, "u1").astype(bool)
        at += docs
        self.sizes = take(docs, "<u8").astype(np.int64)

    def blocks_of(self, first: int, end: int) -> np.ndarray:
        """Ids of blocks ``first`` to ``end``, without reading any other."""
        a, b = int(self.starts[first]), int(self.starts[end])
        words = np.frombuffer(self.file.read_at((b - a) * 8, a * 8), "<u8")
        n = min(self.ids, end * BLOCK) - first * BLOCK
        return unpack(words, self.starts[first : end + 1] - a, n)

    def documents(self, run: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, position of its first id in the file, ids) of each document."""
        ends = np.cumsum(self.sizes)
        k = 0
        while k < len(ends):
            begin = int(ends[k] - self.sizes[k])
            stop = max(k + 1, int(np.searchsorted(ends, begin + run, "right")))
            first = begin // BLOCK
            ids = self.blocks_of(first, min(self.blocks, -(-int(ends[stop - 1]) // BLOCK))) if ends[stop - 1] > begin else np.empty(0, np.uint64)
            for i in range(k, stop):
                a = int(ends[i] - self.sizes[i]) - first * BLOCK
                yield None if self.null[i] else int(self.doc_ids[i]), a + first * BLOCK, ids[a : a + int(self.sizes[i])]
            k = stop


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _cuts(docs: DataFrame, parts: int, sample: int = 100) -> list[tuple]:
    """Where ``docs`` (``doc_id``, ``tie``, ``row``) are cut in ``parts`` ranges: keys from a sample of about ``sample`` rows a range.

    The sample decides how even the ranges are, and nothing else.
    """
    share = min(1.0, sample * parts / max(1, docs.count()))
    keys = sorted((r.doc_id is not None, r.doc_id or 0, r.tie, r.row) for r in docs.select("doc_id", "tie", "row").sample(share, seed=5).collect())
    return [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []


def encoded(docs: DataFrame, path: str, end_id: int, cuts: list[tuple]) -> DataFrame:
    """(``doc_id``, ``tie``, ``row``, ``range`` among ``cuts``, ``ids`` as little-endian integers of ``_wide`` bytes) of every row."""
    wide = _wide(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for k in range(0, b.num_rows, 512):
                some = b.slice(k, 512)
                ids = [x + end for x in encoder(path, False, PARTS).encode(some.column("text").to_pylist())]
                if wide == 2:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                keys = zip(*(some.column(c).to_pylist() for c in ("doc_id", "tie", "row")), strict=True)
                at = [bisect_right(cuts, (d is not None, d or 0, t, r)) for d, t, r in keys]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("tie"), some.column("row"), pa.array(at, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "tie", "row", "range", "ids"]
                )

    return docs.mapInArrow(freeing(run), "doc_id bigint, tie bigint, row bigint, range int, ids binary")


def _wide(path: str) -> int:
    """Bytes that any id of a vocabulary file needs: 2 or 4."""
    return 2 if encoder(path, False, PARTS).tokenizer.get_vocab_size() <= 1 << 16 else 4


def write(docs: DataFrame, uri: str, path: str | None = None, end_id: int = 1, file_ids: int = 1 << 24) -> DataFrame:
    """Encode every text, append ``end_id``, and write files below ``uri`` in ascending ``doc_id`` order.

    Texts are encoded where they lie, and what is sorted is their ids, once: the
    ranges are cut at keys of a sample of rows before anything is encoded.

    Returns the manifest (``part``, ``seq``, ``uri``, ``n_docs``, ``n_ids``);
    files follow one another by ``part`` and ``seq``.  Only files that it names
    count: a task that was lost and run again leaves one that it doesn't name,
    so the frame must be written before it is used twice.  Null ids come first,
    equal ids in order of ``xxhash64`` of the text, however many there are; a
    null text has only the end id.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or vocabulary()
    if docs.schema["doc_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("doc_id must be an integer")
    kind = f"<u{_wide(path)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, out = TaskContext.get().partitionId(), [], None
        for b in batches:
            for k in range(0, b.num_rows, 512):
                some = b.slice(k, 512)
                if out is None:
                    out = Writer(f"{uri}/{part:06d}-{len(made):04d}-{uuid.uuid4().hex}.s8b")
                out.add(some.column("doc_id").to_pylist(), some.column("ids").to_pylist(), kind)
                if out.ids >= file_ids:
                    out.close()
                    made.append(out)
                    out = None
        if out is not None:
            out.close()
            made.append(out)
        yield pa.RecordBatch.from_pydict(
            {"part": [part] * len(made), "seq": list(range(len(made))), "uri": [x.uri for x in made], "n_docs": [len(x.sizes) for x in made], "n_ids": [x.ids for x in made]},
            pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"), "text")
    ranged = encoded(rows, path, end_id, _cuts(rows, parts)).repartitionById(parts, F.col("range"))
    ordered = ranged.sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "ids")
    return ordered.mapInArrow(freeing(run), "part int, seq int, uri string, n_docs bigint, n_ids bigint")


def read(manifest: DataFrame) -> DataFrame:
    """(``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``) of every document, from the files.

    ``start`` counts the ids of all documents before it.  The sums run over the
    manifest, which has a row for each file.
    """
    ship(manifest.sparkSession)
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("uri", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            for uri, base in zip(b.column("uri").to_pylist(), b.column("base").to_pylist(), strict=True):
                found = ((d, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in Reader(uri).documents())
                while rows := list(islice(found, 20_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # a given number of partitions isn't merged, however small the manifest is
    return files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op10(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "simple8b")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(scratch.table(write(docs, f"{scratch.base}/ids"), "manifest"))
