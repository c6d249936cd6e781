"""Source divergence audit: how the words of each source differ from those of its language and of the other sources.

Terms are runs of ASCII letters and of bytes from 0x80 on, A-Z lower-cased.  A
look-up table over the concatenated UTF-8 buffers of many texts says which
bytes belong to terms; the edges of that mask, and the ends of texts, are the
terms' ends.  Slices are grouped by their xxHash, and every slice's bytes are
compared with those of the first of its group, so that a collision can't join
two terms.  A worker sums what it counts and sends a row a group and term.

A language keeps the terms of ``min_docs`` of its documents or more.  All groups
of a language give each kept term an integer share of 10^9 in which each
count is raised by ``prior``.  Two groups differ by the sum of the differences of their shares over
all kept terms.  Kept terms are dealt to blocks, and a block is a sparse matrix of
shares by source (CSR): a term that a source doesn't have has that source's
least share, so the difference of a source to all others is a sum over their
entries (``reduceat``), and over the source's own entries by look-ups in their
running sum.  Blocks have a bounded number of entries whatever the sources and
languages are, and their sums are added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import Scratch, freeing, ship

MIN_DOCS = 30
PRIOR = 5
TOP = 50
WHOLE = 1_000_000_000
#: Bytes of texts that are cut at a time, rows that a worker holds, and entries of a block.
CHUNK = 1 << 20
HELD = 400_000
BLOCK = 1 << 16

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_LOW = np.where(_UPPER, _BYTES + 0x20, _BYTES).astype(np.uint8)
_IS_TERM = _UPPER | (_BYTES >= 0x61) & (_BYTES <= 0x7A) | (_BYTES >= 0x80)


def boundaries(low: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of each term of a buffer, in which texts end at ``ends``."""
    term = np.concatenate([[False], _IS_TERM[low], [False]])
    cut = np.zeros(len(low) + 1, bool)
    cut[ends] = True
    here, before = term[1:], term[:-1]
    return np.flatnonzero((here & (~before | cut))[:-1]), np.flatnonzero(before & (~here | cut))


def grouped(low: np.ndarray, start: np.ndarray, end: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(number of its term for each slice, a slice of each term): slices of one number have the same bytes, verified."""
    data = low.tobytes()
    hashes = np.fromiter(map(digest, map(data.__getitem__, map(slice, start.tolist(), end.tolist()))), np.uint64, len(start))
    _, first, term = np.unique(hashes, return_index=True, return_inverse=True)
    size, like = end - start, first[term]
    same = size == size[like]
    check = np.flatnonzero(same & (like != np.arange(len(start))))
    if len(check):
        n = size[check]
        at = np.cumsum(n) - n
        step = np.arange(at[-1] + n[-1]) - np.repeat(at, n)
        differ = low[np.repeat(start[check], n) + step] != low[np.repeat(start[like[check]], n) + step]
        same[check] = np.add.reduceat(differ, at, dtype=np.int64) == 0
    others: dict[bytes, int] = {}
    more: list[int] = []
    for k in np.flatnonzero(~same).tolist():  # of another term with the same hash
        bytes_ = data[start[k] : end[k]]
        if bytes_ not in others:
            others[bytes_] = len(first) + len(more)
            more.append(k)
        term[k] = others[bytes_]
    return term, np.concatenate([first, np.array(more, np.int64)])


def _counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> pa.Table:
    """(``g``, ``term``, ``n`` occurrences, ``d`` documents) of texts that lie at ``offsets`` of a buffer, each in a ``group``."""
    low = _LOW[data[offsets[0] : offsets[-1]]]
    ends = offsets - offsets[0]
    start, end = boundaries(low, ends)
    term, first = grouped(low, start, end)
    doc = np.searchsorted(ends, start, "right") - 1
    pair, n = np.unique(doc * len(first) + term, return_counts=True)
    key = group[pair // max(1, len(first))] * len(first) + pair % max(1, len(first))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    cells = key[at]
    text = low.tobytes()
    names = pa.array([text[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], pa.binary()).cast(pa.string())
    total = np.add.reduceat(n, at) if len(at) else n
    docs = np.diff(np.concatenate([at, [len(key)]]))
    return pa.table({"g": pa.array(cells // max(1, len(first))), "term": names.take(pa.array(cells % max(1, len(first)))), "n": pa.array(total.astype(np.int64)), "d": pa.array(docs.astype(np.int64))})


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["g", "term"]).aggregate([("n", "sum"), ("d", "sum")]).rename_columns(["g", "term", "n", "d"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []

    def out() -> Iterator[pa.RecordBatch]:
        rows = _summed(held)
        langs, sources = (pa.array([k[i] for k in groups], pa.string()) for i in (0, 1))
        at = rows.column("g").combine_chunks()
        yield from pa.table({"lang": langs.take(at), "source": sources.take(at), "term": rows.column("term"), "n": rows.column("n"), "d": rows.column("d")}).to_batches(max_chunksize=50_000)

    for b in batches:
        if not b.num_rows:
            continue
        codes = np.array([groups.setdefault(k, len(groups)) for k in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)], np.int64)
        text = b.column("text")
        _, where, data = text.buffers()
        wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
        offsets = np.frombuffer(where, wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
        k = 0
        while k < len(text):
            to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK, "right")) - 1)
            held.append(_counts(data, offsets[k : to + 1], codes[k:to]))
            k = to
            if sum(map(len, held)) > HELD:
                held = [_summed(held)]
                if len(held[0]) > HELD // 2:
                    yield from out()
                    held = []
        if not held:
            groups = {}
    if held:
        yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(``lang``, ``source``, ``term``, ``n`` occurrences, ``d`` documents), several rows a term; ``docs`` have ``lang``, ``source`` and ``text``, none null."""
    ship(docs.sparkSession)
    return docs.select("lang", "source", "text").mapInArrow(freeing(_counted), "lang string, source string, term string, n bigint, d bigint")


def _share(n: str, total: str) -> Column:
    """The integer share of a count, by columns' names, exact for all counts: 31 digits hold the dividend."""
    whole = f"CAST({WHOLE} AS DECIMAL(10,0)) * CAST({n} + {{p}} AS DECIMAL(20,0))".format(p=PRIOR)
    return F.expr(f"CASE WHEN {total} + {PRIOR} * V > 0 THEN 1 + ({whole}) div CAST({total} + {PRIOR} * V AS DECIMAL(20,0)) ELSE 0 END").cast("bigint")


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of equal ``keys`` in rows sorted by them, none of them null; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for c in keys:
            col = b.column(c)
            change |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        first = tuple(b.column(c)[0].as_py() for c in keys)
        for s, e in zip(cuts, cuts[1:], strict=False):
            if held and (s or first != last):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(s, e - s))
        last = tuple(b.column(c)[-1].as_py() for c in keys)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def differences(source: np.ndarray, term: np.ndarray, share: np.ndarray, least: np.ndarray, n_terms: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each source its number and the sums of differences to all later ones, over ``n_terms`` terms.

    Entries are (``source``, ``term``, ``share``), by source; any other share is the source's ``least``.
    """
    n = len(least)
    begin = np.searchsorted(source, np.arange(n + 1))
    dense = np.empty(n_terms, np.int64)
    for g in range(n - 1):
        own = slice(begin[g], begin[g + 1])
        dense[:] = least[g]
        dense[term[own]] = share[own]
        later = least[g + 1 :]
        # as if the later ones had nothing but least shares: own entries by their running sum, and all other terms
        low = np.sort(share[own])
        upto = np.concatenate([[0], np.cumsum(low)])
        k = np.searchsorted(low, later)
        sums = later * (2 * k - len(low)) - 2 * upto[k] + upto[-1] + (n_terms - len(low)) * np.abs(later - least[g])
        # and what their entries change
        at, rest = begin[g + 1 : -1], slice(begin[g + 1], None)
        some = np.flatnonzero(np.diff(begin[g + 1 :]) > 0)
        if len(some):
            mine = dense[term[rest]]
            change = np.abs(share[rest] - mine) - np.abs(least[source[rest]] - mine)
            sums[some] += np.add.reduceat(change, at[some] - begin[g + 1])
        yield g, sums


def _divergences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _runs(batches, ("lang", "block")):
        lang = rows.column("lang")[0].as_py()
        head = rows.column("term").is_null().to_numpy()  # a source's first row
        names, least = rows.column("source").filter(pa.array(head)).combine_chunks(), rows.column("p").to_numpy()[head]
        source = (np.cumsum(head) - 1)[~head]
        words = rows.column("term").drop_null().combine_chunks().dictionary_encode()
        found = differences(source, words.indices.to_numpy().astype(np.int64), rows.column("p").to_numpy()[~head], least, len(words.dictionary))
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        value: list[np.ndarray] = []
        for g, sums in found:
            a.append(np.full(len(sums), g))
            b.append(np.arange(g + 1, len(least)))
            value.append(sums)
            if g == len(least) - 2 or sum(map(len, a)) > 100_000:
                x, y = (names.take(pa.array(np.concatenate(z))) for z in (a, b))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), x, y, pa.array(np.concatenate(value))], ["lang", "a", "b", "value"])
                a, b, value = [], [], []


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, broadcast_rows: int = 100_000) -> DataFrame:
    """(``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``) over all documents.

    ``part`` is ``pair``, with a row for each other source of the language and the
    two sources' difference, or ``term``, with the ``top`` kept terms whose share
    in the source is most above their share in the language.  Ranks go from 1
    in each group and part by falling value, then item.

    Null languages, sources and texts count as empty ones, and every row is a
    document, whatever its other columns are.  A language without kept terms has pairs of value 0, a source that
    is alone in its language has none, and an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    term = Window.partitionBy("lang", "term")
    # one exchange by language and term serves the sums of groups and those of the language
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    counts = counts.select("lang", "source", "term", "n", F.sum("d").over(term).alias("_d"), F.sum("n").over(term).alias("lang_n"), (F.min("source").over(term) == F.col("source")).alias("first"))
    kept = scratch.table(counts.where(F.col("_d") >= min_docs).drop("_d"), "kept")
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("V"), F.count("*").alias("_rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    groups = docs.select("lang", "source").distinct().join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.select("lang", "source", zero("total"), zero("lang_total"), zero("V"), F.greatest(F.ceil(F.coalesce("_rows", F.lit(0)) / block), F.lit(1)).cast("int").alias("blocks"))
    groups = scratch.table(groups.withColumn("least", _share("0", "total")), "groups")
    few = F.broadcast(groups) if groups.count() <= broadcast_rows else groups
    shares = kept.join(few, ["lang", "source"]).withColumn("p", _share("n", "total")).withColumn("q", _share("lang_n", "lang_total"))

    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    entries = shares.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "p")
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.col("least").alias("p"))
    units = entries.unionByName(heads).repartition("lang", "block").sortWithinPartitions("lang", "block", "source", "term")
    sums = units.mapInArrow(freeing(_divergences), "lang string, a string, b string, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    pairs = sums.select("lang", both, "value").select("lang", "x.source", "x.item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionByName(ranked(above, "term").where(F.col("rank") <= top))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCS}
), totals AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), c AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(x.n, 0) AS n, k.n AS lang_n, sum(coalesce(x.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
), s AS MATERIALIZED (
  SELECT c.lang, source, term, c.n, 1 + (CAST({WHOLE} AS HUGEINT) * (c.n + {PRIOR})) // (total + {PRIOR} * v) AS p, 1 + (CAST({WHOLE} AS HUGEINT) * (lang_n + {PRIOR})) // (t.n + {PRIOR} * v) AS q FROM c JOIN totals t USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), rows_ AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM rows_ QUALIFY part = 'pair' OR rank <= {TOP}
"""


def op11(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
