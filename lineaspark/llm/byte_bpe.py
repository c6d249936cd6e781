"""Byte-level BPE with the tokenizers library: ids, offsets and exact decoding.

The library writes every byte of a token as one printable character.  The
table of those characters is a rule (printable Latin-1 bytes stand for
themselves, the others take the code points from 256 on), and reversing it
gives the bytes of each id.  Token lengths then give byte offsets, and counting
the bytes that start a character turns them into code point offsets, also where
a character's bytes are split over tokens.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import byte_characters, encoder
from .shared import freeing, ship

SLICE = 1 << 20  # ids that are decoded together
PARTS = 300_000  # parts whose ids a worker keeps


class ByteTable:
    """Bytes of every id of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        special = {x["content"] for x in spec["added_tokens"]}
        vocab = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
        parts = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            parts[i] = token.encode() if token in special else bytes(byte_of[c] for c in token)
        self.length = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The exact bytes; they need not be whole characters if ``ids`` are a part of a text's."""
        out = []
        for k in range(0, len(ids), SLICE):
            some = ids[k : k + SLICE]
            n = self.length[some]
            ends = np.cumsum(n)
            at = np.repeat(self.start[some] - (ends - n), n) + np.arange(ends[-1])
            out.append(self.flat[at].tobytes())
        return b"".join(out)

    def text(self, ids: np.ndarray) -> str:
        """The text; characters cut off at either end become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")

    def offsets(self, ids: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last code point of each id.

        An id that holds only a part of a character has the whole character's offsets.
        """
        ends = np.cumsum(self.length[ids])
        begins = ends - self.length[ids]
        starts_char = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(starts_char)])  # characters begun before a byte
        return before[begins + 1] - 1, before[ends]


_tables: dict[str, ByteTable] = {}


def table(path: str) -> ByteTable:
    if path not in _tables:
        _tables[path] = ByteTable(path)
    return _tables[path]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(``doc_id``, ``ids``, ``starts``, ``ends``) for every row.

    Offsets are code points, ends exclusive.  A null or empty text has no ids.
    """
    ship(docs.sparkSession)
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in encoder(path, True, PARTS).encode(texts)]
            spans = [t.offsets(i, (x or "").encode()) for i, x in zip(ids, texts, strict=True)]
            cols = [ids, [s for s, _ in spans], [e for _, e in spans]]
            arrays = [pa.array([v.astype(np.int32) for v in c], pa.list_(pa.int32())) for c in cols]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", "ids", "starts", "ends"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(freeing(run), f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(``doc_id``, ``data``, ``text``) from ``doc_id`` and ``ids``; null ids give null."""
    ship(tokens.sparkSession)
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for b in batches:
            data = [None if x is None else t.decode(np.array(x, np.int64)) for x in b.column("ids").to_pylist()]
            text = [None if d is None else d.decode("utf-8", "replace") for d in data]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary()), pa.array(text, pa.string())], ["doc_id", "data", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(freeing(run), f"doc_id {kind}, data binary, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``): encoding and decoding in one pass.

    The ids of a batch are decoded where they were made, so they never travel;
    the decoded digest is of the bytes that the ids give, not of the text.
    """
    ship(docs.sparkSession)
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for b in batches:
            n, ids, data = [], [], []
            for k in range(0, b.num_rows, 256):
                for x in encoder(path, True, PARTS).encode(b.column("text")[k : k + 256].to_pylist()):
                    n.append(len(x) // 4)
                    ids.append(hashlib.sha256(x).hexdigest())
                    data.append(hashlib.sha256(t.decode(np.frombuffer(x, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        freeing(run), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
