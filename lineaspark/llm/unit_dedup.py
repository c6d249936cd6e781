"""Substring dedup by hashing units.

Texts are cut at line ends into lines and lines after ``.``, ``!`` or ``?`` and
a space into sentences, so a shared passage that begins in the middle of a line
is still found, but for its ragged ends.  A unit of at least ``least_words``
words is normalised (lower case, white space as one space) and its 128-bit
digest is grouped over all documents; the earliest occurrence (by document,
then place) stays, and every other one is removed.  Offsets are code points of
the original text throughout.

A shorter unit is no match by itself but, in the query, in a passage: from each one a window
of consecutive units, short or not, goes on until it has ``PASSAGE`` words, and
another goes back.  Windows are grouped like units.  A shared passage of twice
that length has such a window for each of its short units.  Of a script without
spaces two characters count as a word, and its full stops end sentences.

With ``least_run`` what repeats is removed only where it goes on for so many
words: single sentences that many documents share, such as notices, stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .line_dedup import numbered
from .shared import Scratch, freeing, packed, ship, unpacked

_UNIT = re.compile(r"[^\n]*?(?:[.!?](?=[ \n])|[\u3002\uff01\uff1f])|[^\n]+")
_CLOSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
LEAST_WORDS = 8
PASSAGE = 25
RUN = 20  # words of a repeated run that the query removes


def _length(unit: str, words: list[str]) -> int:
    """Words of a unit; two characters of a script without spaces count as one."""
    close = [] if unit.isascii() else _CLOSE.findall(unit)
    return len(_CLOSE.sub(" ", unit).split()) + sum((len(x) + 1) // 2 for x in close) if close else len(words)


def units(text: str | None, least_words: int = LEAST_WORDS, passage: int | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, end, words before it, words up to its end, 128-bit digest) of a whole text's units, and with ``passage`` its windows of so many words, white space at their ends left out."""
    spans, normals, total = [], [], [0]
    for m in _UNIT.finditer(text or ""):
        words = m[0].split()
        if not words:
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        spans.append((start, start + len(m[0].strip())))
        normals.append(" ".join(words).lower())
        total.append(total[-1] + _length(m[0], words))
        if total[-1] - total[-2] >= least_words:
            yield *spans[-1], total[-2], total[-1], xxhash.xxh3_128_intdigest(normals[-1])
    windows = set()
    for k in range(len(spans)) if passage else ():
        if total[k + 1] - total[k] < least_words:
            last = bisect_left(total, total[k] + passage)
            if last < len(total):
                windows.add((k, last))
            first = bisect_right(total, total[k + 1] - passage) - 1
            if first >= 0:
                windows.add((first, k + 1))
    for a, z in sorted(windows):
        yield spans[a][0], spans[z - 1][1], total[a], total[z], xxhash.xxh3_128_intdigest(" ".join(normals[a:z]))


def occurrences(docs: DataFrame, least_words: int = LEAST_WORDS, passage: int | None = None) -> DataFrame:
    """(``h1``, ``h2``, ``_doc``, ``start``, ``end``, ``w0``, ``w1``) of every unit and window of ``docs`` (``_doc``, ``text``)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                row, places, digest = [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    for *place, h in units(text, least_words, passage):
                        row.append(i)
                        places.append(place)
                        digest.append(h.to_bytes(16, "little"))
                h = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                at = np.array(places, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), part.column("_doc").take(pa.array(row, pa.int64())), *(pa.array(at[:, c]) for c in range(4))],
                    ["h1", "h2", "_doc", "start", "end", "w0", "w1"],
                )

    kind = docs.schema["_doc"].dataType.simpleString()
    return docs.select("_doc", "text").mapInArrow(freeing(run), f"h1 bigint, h2 bigint, _doc {kind}, start bigint, end bigint, w0 bigint, w1 bigint")


def _removed(docs: DataFrame, scratch: Scratch, least_words: int, passage: int | None, least_run: int) -> DataFrame:
    """(``_doc``, ``start``, ``end``, ``first`` place of what is kept) of ``docs`` (``_doc``, ``text``)."""
    found = scratch.table(occurrences(docs, least_words, passage), "units")
    place = F.struct("_doc", "start")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h1", "h2", "first")
    first = scratch.table(first, "first")
    again = found.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    if not least_run:
        return again
    # units follow one another if one has its words right behind the other's
    order = Window.partitionBy("_doc").orderBy("w0", "w1")
    before = F.max("w1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = again.withColumn("_new", F.coalesce((F.col("w0") > before).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("_doc", "_run")
    return runs.withColumn("_words", F.max("w1").over(whole) - F.min("w0").over(whole)).where(F.col("_words") >= least_run)


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS, passage: int | None = None, least_run: int = 0) -> DataFrame:
    """(``doc_id``, ``start``, ``end``, ``kept_doc_id``, ``kept_start``): a row for each unit or window that is removed; rows may overlap.

    Null and empty texts have no units.  Null ids rank first, and rows that
    share an id, or have none, are documents of their own, in order of row.
    """
    scratch = Scratch(docs.sparkSession, "units")
    docs = numbered(docs.select("doc_id", "text"), scratch)
    return _removed(docs, scratch, least_words, passage, least_run).select(
        F.col("_doc.doc_id").alias("doc_id"), "start", "end", F.col("first._doc.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start")
    )


def dedup_units(docs: DataFrame, least_words: int = LEAST_WORDS, passage: int | None = None, least_run: int = 0) -> DataFrame:
    """``docs`` without the removed units, all columns kept, and ``removed``: array<struct<start, end>> in original offsets (in place of a column of that name)."""
    columns = [c for c in docs.columns if c != "removed"]
    scratch = Scratch(docs.sparkSession, "units")
    docs = numbered(packed(docs.drop("removed"), "doc_id", "text"), scratch)
    spans = _removed(docs.select("_doc", "text"), scratch, least_words, passage, least_run)
    spans = spans.groupBy("_doc").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("start", "end")))).alias("_removed"))
    rows = docs.join(spans.withColumnRenamed("_doc", "_key"), F.col("_doc").eqNullSafe(F.col("_key")), "left")

    @F.pandas_udf("string")
    def cut(text, removed):
        def one(t, r):
            if t is None or r is None:
                return t
            out, at = [], 0
            for x in r:
                out.append(t[at : x["start"]])
                at = max(at, x["end"])
            return "".join([*out, t[at:]])

        return text.__class__([one(t, r) for t, r in zip(text, removed, strict=True)], dtype=object)

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return unpacked(rows.withColumn("text", cut("text", "_removed")), columns, ("doc_id", "text"), F.coalesce("_removed", none).alias("removed"))


def op2(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), passage=PASSAGE, least_run=RUN)
