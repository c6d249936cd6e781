"""Media columns in archives, read by a custom data source.

A payload is stored as an 8-bit greyscale PNG, 64 samples a line, and images
are members of uncompressed ZIP archives in the shared folder.  The manifest,
a Parquet table, has a row for each stretch of an archive with the places of
its members, so nobody reads an archive's whole directory.  The data source
``member_ranges`` plans byte ranges over the archives from the manifest's footers
alone, which say how many stretches there are and how long the longest is; a
task reads the stretches that its ranges are of, and streams the members whose
records begin in them as Arrow batches of bounded size.  Each member is
read by its own offset and retried on its own; one that stays unreadable gives
a row with an error and no bytes, and the others are not read again.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import Scratch, freeing, ship

LINE = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_WHEN = (1980, 1, 1, 0, 0, 0)
BATCH_BYTES = 8 << 20


def payload_of(text: str | None) -> bytes:
    """UTF-8 and zero bytes up to a positive multiple of 64; a null text is empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(LINE, -(-len(data) // LINE) * LINE), b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """An image whose samples are the payload; the unpadded length is a text chunk."""
    lines = len(payload) // LINE
    rows = np.zeros((lines, LINE + 1), np.uint8)  # each line begins with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(lines, LINE)
    head = struct.pack(">IIBBBBB", LINE, lines, 8, 0, 0, 0, 0)
    body = zlib.compress(rows.tobytes(), 1)
    return b"".join([_SIGNATURE, _chunk(b"IHDR", head), _chunk(b"tEXt", b"bytes\0%d" % n_bytes), _chunk(b"IDAT", body), _chunk(b"IEND", b"")])


def from_png(image: bytes) -> tuple[bytes, int]:
    """Payload and unpadded length; every chunk's checksum is tested."""
    if not image.startswith(_SIGNATURE):
        raise ValueError("not a PNG")
    at, size, body, n = len(_SIGNATURE), (0, 0), [], None
    while at < len(image):
        length, kind = struct.unpack_from(">I4s", image, at)
        data = image[at + 8 : at + 8 + length]
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", image, at + 8 + length)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">II", data[:8])
        elif kind == b"tEXt":
            n = int(data.split(b"\0")[1])
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + length
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], LINE + 1)
    return rows[:, 1:].tobytes(), n


def feature_of(payload: bytes) -> str:
    """Lines, mean, and a 64-bit hash: which of 64 equal parts of the samples are brighter than the whole."""
    x = np.frombuffer(payload, np.uint8)
    ends = np.arange(65) * len(x) // 64
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    part = total[ends[1:]] - total[ends[:-1]]
    bright = part * len(x) > total[-1] * (ends[1:] - ends[:-1])
    return f"{len(x) // LINE}:{int(total[-1]) // len(x)}:{np.packbits(bright).tobytes().hex()}"


def _open(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


_INDEX = pa.schema([
    ("uri", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("bytes", pa.int64()), ("members", pa.int64()),
    ("places", pa.list_(pa.struct([("member", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("crc", pa.int64())]))),
])
_INDEX_SQL = "uri string, first bigint, end bigint, bytes bigint, members bigint, places array<struct<member:string,at:bigint,size:bigint,crc:bigint>>"


def member_name(doc_id, n: int) -> str:
    """A member's name: the id as text, quoted, or a dash if there is none, and a number."""
    return f"{'-' if doc_id is None else '=' + quote(str(doc_id), safe='')}.{n}.png"


def id_of(member: str) -> str | None:
    name = member.split(".")[0] if member[0] == "-" else member.rsplit(".", 2)[0]
    return None if name == "-" else unquote(name[1:])


def write(docs: DataFrame, uri: str, archive_bytes: int = 256 << 20, stretch_bytes: int = 16 << 20) -> DataFrame:
    """Store every row's payload in archives below ``uri``; gives the manifest (``uri``, ``first``, ``end``, ``bytes``, ``members``, ``places``), a row a stretch.

    Members are named by ``doc_id`` (of any type, as text) and a number, so
    repeated and null ids keep a member each.  Only archives in the manifest
    count (a lost task leaves one that isn't), so the frame must be written
    before it is used twice.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = out = None
        part, made, first, places = TaskContext.get().partitionId(), 0, 0, []

        def stretch() -> pa.RecordBatch:
            nonlocal first, places
            row = {"uri": name, "first": first, "end": out.tell(), "bytes": out.tell() - first, "members": len(places), "places": places}
            first, places = out.tell(), []
            return pa.RecordBatch.from_pylist([row], _INDEX)

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                if archive is None:
                    name = f"{uri}/{part:06d}-{made:04d}-{uuid.uuid4().hex}.zip"
                    fs, path = pyarrow.fs.FileSystem.from_uri(name)
                    fs.create_dir(path.rsplit("/", 1)[0])
                    out, first, n, made = fs.open_output_stream(path), 0, 0, made + 1
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                payload = payload_of(text := text.as_py())
                info = zipfile.ZipInfo(member_name(doc_id, n), _WHEN)
                archive.writestr(info, to_png(payload, len((text or "").encode("utf-8", "surrogatepass"))))
                places.append({"member": info.filename, "at": info.header_offset, "size": info.file_size, "crc": info.CRC})
                n += 1
                if out.tell() - first >= stretch_bytes or out.tell() > archive_bytes:
                    yield stretch()
                if out.tell() > archive_bytes:
                    archive.close()
                    out.close()
                    archive = None
        if archive is not None:
            if places:
                yield stretch()
            archive.close()
            out.close()

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(freeing(run), _INDEX_SQL)


class Range(InputPartition):
    """Byte ranges: (manifest file, first and end of their numbers in it, ranges a stretch)."""

    def __init__(self, pieces: list[tuple[str, int, int, int]]):
        self.pieces = pieces


class MemberRanges(DataSource):
    """Options: ``manifest`` (folder of a manifest in Parquet), ``range_bytes`` and ``attempts``."""

    @classmethod
    def name(cls) -> str:
        return "member_ranges"

    def schema(self) -> str:
        return "archive string, member string, record_at bigint, attempts int, error string, media binary"

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options)


class MemberReader(DataSourceReader):
    def __init__(self, options):
        self.manifest = options["manifest"]
        self.step = int(options.get("range_bytes", 16 << 20))
        self.most = int(options.get("partitions", 100_000))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[Range]:
        """Byte ranges by number, of all stretches in order; of a manifest's file only the footer is read here."""
        fs, path = pyarrow.fs.FileSystem.from_uri(self.manifest)
        files = []
        for name in sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.path.endswith(".parquet")):
            with fs.open_input_file(name) as f:
                footer = pq.ParquetFile(f).metadata
            column = footer.schema.names.index("bytes")
            longest = max((footer.row_group(g).column(column).statistics.max for g in range(footer.num_row_groups)), default=0)
            if footer.num_rows:
                splits = max(1, -(-longest // self.step))
                files.append((name, footer.num_rows * splits, splits))
        each = max(1, -(-sum(n for _, n, _ in files) // self.most))
        out, pieces, room = [], [], each
        for name, n, splits in files:
            at = 0
            while at < n:
                took = min(room, n - at)
                pieces.append((name, at, at + took, splits))
                at, room = at + took, room - took
                if not room:
                    out.append(Range(pieces))
                    pieces, room = [], each
        return [*out, Range(pieces)] if pieces or not out else out

    def places(self, piece: tuple[str, int, int, int]) -> Iterator[tuple[str, list[dict]]]:
        """(archive, members whose records begin in the ranges) for each stretch that the ranges are of; only its row group is read."""
        name, lo, hi, splits = piece
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.manifest)
        with fs.open_input_file(name) as f:
            file, at = pq.ParquetFile(f), 0
            for g in range(file.num_row_groups):
                n = file.metadata.row_group(g).num_rows
                first, end = max(lo // splits, at), min((hi - 1) // splits + 1, at + n)
                if first < end:
                    rows = file.read_row_group(g, columns=["uri", "first", "end", "places"]).slice(first - at, end - first)
                    for k in range(rows.num_rows):
                        (r,) = rows.slice(k, 1).to_pylist()
                        row = (first + k) * splits  # the number of its first range
                        begin, stop = r["first"] + max(0, lo - row) * self.step, r["first"] + min(splits, hi - row) * self.step
                        yield r["uri"], [m for m in r["places"] if begin <= m["at"] < min(stop, r["end"])]
                at += n

    def fetch(self, file, at: int, size: int) -> bytes:
        """One member's bytes by the offset of its record; tests override it to fail."""
        head = file.read_at(30, at)
        if head[:4] != b"PK\x03\x04":
            raise OSError("no record here")
        name, extra = struct.unpack_from("<HH", head, 26)
        return file.read_at(size, at + 30 + name + extra)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for uri, members in (x for piece in partition.pieces for x in self.places(piece)):
            if not members:
                continue
            file = _open(uri)
            for m in members:
                data, error, tries = None, None, 0
                while data is None and tries < self.attempts:
                    tries += 1
                    try:
                        got = self.fetch(file, m["at"], m["size"])
                        if zlib.crc32(got) != m["crc"]:
                            raise OSError("checksum differs")
                        data, error = got, None
                    except OSError as e:
                        error = str(e)
                        time.sleep(0.01 * tries)
                        file.close()
                        file = _open(uri)  # a broken connection mustn't fail the next try
                rows.append((uri, m["member"], m["at"], tries, error, data))
                held += len(data or b"")
                if held >= BATCH_BYTES or len(rows) >= 2000:
                    yield self._batch(rows)
                    rows, held = [], 0
            file.close()
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("archive", pa.string()), ("member", pa.string()), ("record_at", pa.int64()), ("attempts", pa.int32()), ("error", pa.string()), ("media", pa.binary())]
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], schema=pa.schema(kinds))


def read(spark, manifest_dir: str, **options) -> DataFrame:
    """All members that the manifest's archives hold."""
    ship(spark)
    spark.dataSource.register(MemberRanges)
    reader = spark.read.format("member_ranges").option("manifest", manifest_dir)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def features(members: DataFrame) -> DataFrame:
    """Digests and features of stored images, ``doc_id`` as text; a member without bytes has nulls."""
    ship(members.sparkSession)
    kinds = [("doc_id", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, media, error in zip(b.column("member").to_pylist(), b.column("media"), b.column("error").to_pylist(), strict=True):
                key = id_of(name)
                if (image := media.as_py()) is None:
                    rows.append((key, *[None] * 7, error))
                    continue
                payload, n = from_png(image)
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-LINE:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(payload), error))
            cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], schema=pa.schema(kinds))

    return members.select("member", "media", "error").mapInArrow(
        freeing(run), "doc_id string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, error string"
    )


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every payload, read the archives back, and describe what was read: a row for each of ``docs``, ids of their own type."""
    scratch = Scratch(docs.sparkSession, "media")
    # small row groups, as a task reads the one that has its stretch
    write(docs, f"{scratch.base}/archives").write.option("parquet.block.size", 1 << 20).parquet(f"{scratch.base}/manifest")
    found = features(read(docs.sparkSession, f"{scratch.base}/manifest"))
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op8(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
