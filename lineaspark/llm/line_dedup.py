"""Line dedup by a suffix array over line-ID sequences.

Every line that is not blank gets an id, and a document is the sequence of its
line ids.  Prefix doubling ranks suffixes by their first 2^k lines: the rank at
level k+1 comes from sorting the pairs (rank here, rank 2^k lines on).  Equal
ranks at level k are exactly the intervals of the suffix array whose longest
common prefix is 2^k lines or more.  A suffix that is alone in its interval can
share no longer run, so it leaves; doubling ends when no interval is left.

In each interval the occurrence that comes first (by document, then line)
stays, and the runs at the others are later copies.  Runs of ``min_lines`` or
more are deleted: the prefixes of just so many lines are told apart by two
overlapping ranks of the greatest power of two in it, and the union of the
later ones, cut at gaps, gives the maximal repeated runs.  What a run copies is
the first occurrence of its first ``min_lines`` lines, and how far it goes on
like that, the longest common prefix of the two suffixes, is added up from the
ranks of all levels, the greatest first.

A run of one line counts on request only, if the line is long; the corpus
pipeline asks for that.

Only DataFrame operations.  Ranks are made without a global window: groups are
range-partitioned and sorted, and a row's number within its partition, below
the partition's number, orders all groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .shared import Scratch, packed, unpacked

#: A line counts if it has any character but these.
_NOT_BLANK = r"[^\t\x0B\f\r ]"
#: Words from which a single line counts as a passage, and the characters of scripts without spaces, of which two count as a word.
LONG = 20
_CLOSE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
_IS_LONG = rf"^\s*+(?:(?:[{_CLOSE}]{{2}}|[{_CLOSE}](?![{_CLOSE}])|[^\s{_CLOSE}]++)\s*+){{{LONG}}}"


def _ranked(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Order-preserving ``rank`` of distinct keys."""
    return groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id())


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with a key ``_doc``: the ``doc_id``, if ids are whole and distinct, or else the id and a row number.

    In the second case the rows are written first, since row numbers must not change.
    """
    ids = docs.select("doc_id")
    odd = ids.where("doc_id is null").limit(1).union(ids.groupBy("doc_id").count().where("count > 1").select("doc_id").limit(1))
    if odd.isEmpty():
        return docs.withColumn("_doc", F.struct("doc_id"))
    return scratch.table(docs.withColumn("_doc", F.struct("doc_id", F.monotonically_increasing_id().alias("row"))), "numbered")


def lines_of(docs: DataFrame) -> DataFrame:
    """(``_doc``, ``seq`` among lines that are not blank, ``line_no`` among all, the line's 128-bit id ``h1``, ``h2``, and whether it is ``long``)."""
    split = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    rows = docs.select("_doc", F.posexplode(F.filter(split, lambda x: x["line"].rlike(_NOT_BLANK))).alias("seq", "x"))
    return rows.select("_doc", "seq", "x.line_no", F.xxhash64("x.line").alias("h1"), F.xxhash64(F.lit(7), "x.line").alias("h2"), F.col("x.line").rlike(_IS_LONG).alias("long"))


def intervals(lines: DataFrame, scratch: Scratch, most_levels: int = 40) -> list[DataFrame]:
    """Per level k, up to ``most_levels``, the suffixes that share their first 2^k lines with another: (``_doc``, ``seq``, ``rank``)."""
    names = scratch.table(_ranked(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), ["h1", "h2"]), "names-0")
    found = [scratch.table(lines.join(names, ["h1", "h2"]).select("_doc", "seq", "rank"), "level-0")]
    for k in range(most_levels):
        pairs = scratch.table(_pairs(found[-1], 1 << k), f"pairs-{k + 1}")
        groups = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1")
        names = scratch.table(_ranked(groups.select("r1", "r2"), ["r1", "r2"]), f"names-{k + 1}")
        if names.isEmpty():
            break
        found.append(scratch.table(pairs.join(names, ["r1", "r2"]).select("_doc", "seq", "rank"), f"level-{k + 1}"))
        scratch.drop(f"pairs-{k + 1}")
    return found


def _pairs(level: DataFrame, ahead: int) -> DataFrame:
    """Suffixes with their rank and that of the suffix ``ahead`` lines on, where both have one."""
    there = Window.partitionBy("_doc").orderBy("seq").rangeBetween(ahead, ahead)
    return level.select("_doc", "seq", F.col("rank").alias("r1"), F.max("rank").over(there).alias("r2")).where("r2 is not null")


def long_copies(lines: DataFrame) -> DataFrame:
    """(``_doc``, ``seq``, ``size`` 1) of the later copies of single long lines."""
    some = lines.where("long")
    first = some.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("_doc", "seq")).alias("first")).where("n > 1")
    return some.join(first, ["h1", "h2"]).where(F.struct("_doc", "seq") > F.col("first")).select("_doc", "seq", F.lit(1).alias("size"))


def later_copies(levels: list[DataFrame], min_lines: int) -> DataFrame:
    """(``_doc``, ``seq``, ``size``, ``first``) of the prefixes of ``min_lines`` lines that occurred before, and where they did first."""
    k = min_lines.bit_length() - 1
    if k >= len(levels):
        return levels[0].where("false").select("_doc", "seq", F.lit(min_lines).alias("size"), F.struct("_doc", "seq").alias("first"))
    more = min_lines - (1 << k)
    grams = _pairs(levels[k], more) if more else levels[k].select("_doc", "seq", F.col("rank").alias("r1"), F.lit(0).cast("long").alias("r2"))
    first = grams.groupBy("r1", "r2").agg(F.count("*").alias("n"), F.min(F.struct("_doc", "seq")).alias("first")).where("n > 1")
    return grams.join(first, ["r1", "r2"]).where(F.struct("_doc", "seq") > F.col("first")).select("_doc", "seq", F.lit(min_lines).alias("size"), "first")


def common_prefixes(pairs: DataFrame, levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``pairs`` of suffixes (``_doc``, ``seq`` and ``first``) with ``lcp``, the lines that they have in common from there on.

    A level's ranks say whether the next 2^k lines agree, so one pass over the
    levels from the greatest gives the length, bit by bit.
    """
    now = pairs.withColumn("lcp", F.lit(0))
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k].select("_doc", F.col("seq").alias("_at"), F.col("rank").alias("_r"))
        there = levels[k].select(F.col("_doc").alias("_other"), F.col("seq").alias("_to"), F.col("rank").alias("_s"))
        now = now.withColumn("_at", F.col("seq") + F.col("lcp")).join(here, ["_doc", "_at"], "left").drop("_at")
        now = now.withColumn("_other", F.col("first._doc")).withColumn("_to", F.col("first.seq") + F.col("lcp")).join(there, ["_other", "_to"], "left").drop("_other", "_to")
        same = F.coalesce(F.col("_r") == F.col("_s"), F.lit(False))
        now = scratch.table(now.withColumn("lcp", F.col("lcp") + F.when(same, 1 << k).otherwise(0)).drop("_r", "_s"), f"lcp-{k}")
    return now


def gone_lines(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(``_doc``, ``seq``, ``line_no``) of the lines that runs (``_doc``, ``seq``, ``size``) cover."""
    # a line goes if the furthest end of the runs that begin at or before it lies beyond it
    longest = spans.groupBy("_doc", "seq").agg(F.max("size").alias("size"))
    order = Window.partitionBy("_doc").orderBy("seq")
    rows = lines.select("_doc", "seq", "line_no").join(longest, ["_doc", "seq"], "left")
    reach = F.max(F.col("seq") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("reach", reach).where("reach > seq").select("_doc", "seq", "line_no")


def _runs(gone: DataFrame, by: str) -> DataFrame:
    """(``_doc``, ``seq`` of the first line, ``n`` lines, first ``a`` and last ``b`` line numbers) of the runs without a gap in ``by``."""
    order = Window.partitionBy("_doc").orderBy("seq")
    return gone.withColumn("_run", F.col(by) - F.row_number().over(order)).groupBy("_doc", "_run").agg(F.min("seq").alias("seq"), F.count("*").alias("n"), F.min("line_no").alias("a"), F.max("line_no").alias("b")).drop("_run")


def report(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """(``doc_id``, ``n_lines``, ``n_removed``, ``removed_runs``, ``kept_runs``) for every row; without lines 0, 0 and empty.

    ``removed_runs`` are the maximal deleted runs as ``first-last`` line
    numbers from 0, joined by commas; a run goes on over blank lines.
    ``kept_runs`` has for each of them ``document:line+length``: where its first
    ``min_lines`` lines occur first, and how many lines agree from there on.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = numbered(docs.select("doc_id", "text"), scratch)
    lines = scratch.table(lines_of(docs), "lines")
    levels = intervals(lines, scratch)
    later = scratch.table(later_copies(levels, min_lines), "later")
    runs = _runs(gone_lines(lines, later), "seq").join(later.select("_doc", "seq", "first"), ["_doc", "seq"])
    runs = common_prefixes(scratch.table(runs, "runs"), levels, scratch)
    kept = lines.select(F.struct("_doc", "seq").alias("first"), F.col("line_no").alias("_line"))
    runs = runs.join(kept, "first")
    said = F.concat(F.coalesce(F.col("first._doc.doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("_line").cast("string"), F.lit("+"), F.col("lcp").cast("string"))
    out = runs.groupBy("_doc").agg(F.sum("n").alias("n_removed"), F.array_sort(F.collect_list(F.struct("a", "b", said.alias("said")))).alias("runs"))
    sizes = lines.groupBy("_doc").agg(F.count("*").alias("n_lines"))
    rows = docs.select("doc_id", "_doc").join(sizes, "_doc", "left").join(out, "_doc", "left")
    text = lambda f: F.coalesce(F.array_join(F.transform("runs", f), ","), F.lit(""))
    return rows.select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        text(lambda x: F.concat_ws("-", x["a"], x["b"])).alias("removed_runs"), text(lambda x: x["said"]).alias("kept_runs"),
    )


def dedup_lines(docs: DataFrame, broadcast_lines: int = 2_000_000, min_lines: int = 2, single: bool = True) -> DataFrame:
    """``docs`` without later copies of repeated runs of ``min_lines`` lines or more, or with ``single`` of single lines of ``LONG`` words or more; all columns stay.

    A document that had lines and has only blank ones left goes as a whole; a
    null, empty or blank text stays as it is.

    The lists of runs to delete are broadcast if they hold ``broadcast_lines``
    numbers at most, counted first, so that texts aren't shuffled; beyond that
    the join is by shuffle.
    """
    columns = docs.columns
    scratch = Scratch(docs.sparkSession, "lines")
    docs = numbered(packed(docs, "doc_id", "text"), scratch)
    lines = scratch.table(lines_of(docs.select("_doc", "text")), "lines")
    spans = later_copies(intervals(lines, scratch, min_lines.bit_length() - 1), min_lines).drop("first")  # no level beyond the one that it asks for
    if single:
        spans = spans.unionByName(long_copies(lines))
    gone = scratch.table(gone_lines(lines, spans), "gone")
    cut = _runs(gone, "line_no").groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("_cut"), F.sum("n").alias("n_removed"))
    sizes = lines.join(gone.select("_doc").distinct(), "_doc", "left_semi").groupBy("_doc").agg(F.count("*").alias("n_lines"))
    found = scratch.table(cut.join(sizes, "_doc").select("_doc", "_cut", (F.col("n_lines") == F.col("n_removed")).alias("_all")), "found")
    if (found.agg(F.sum(2 * F.size("_cut") + 8)).first()[0] or 0) <= broadcast_lines:
        found = F.broadcast(found)
    rows = docs.join(found, "_doc", "left").where("not coalesce(_all, false)")
    # what lies between the runs, each piece copied once
    split, ends = F.split("text", "\n", -1), F.transform("_cut", lambda x: x["b"] + 1)
    begins, stops = F.concat(F.array(F.lit(0)), ends), F.concat(F.transform("_cut", lambda x: x["a"]), F.array(F.size(split)))
    pieces = F.transform(F.arrays_zip(begins.alias("x"), stops.alias("y")), lambda p: F.slice(split, p["x"] + 1, p["y"] - p["x"]))
    left = F.array_join(F.flatten(pieces), "\n")
    return unpacked(rows.withColumn("text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(left)), columns, ("doc_id", "text"))


#: The query's runs have three lines or more, told apart by two overlapping pairs; lengths come from all levels.
MIN_LINES = 3

SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents
), s AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS seq
  FROM l WHERE regexp_matches(line, '[^\t\x0B\f\r ]')
), p AS (
  SELECT *, lead(line) OVER w AS second, lead(line, 2) OVER w AS third FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY seq)
), f AS (
  SELECT doc_id, seq, row_number() OVER w AS nth, first_value(doc_id) OVER w AS first_doc, first_value(seq) OVER w AS first_seq, first_value(line_no) OVER w AS first_line
  FROM p WHERE third IS NOT NULL WINDOW w AS (PARTITION BY line, second, third ORDER BY doc_id, seq)
), gone AS (
  SELECT DISTINCT doc_id, seq + k AS seq FROM f, range(3) t(k) WHERE nth > 1
), marked AS (
  SELECT doc_id, seq, line_no, seq - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS run
  FROM gone JOIN s USING (doc_id, seq)
), cut AS (
  SELECT doc_id, min(seq) AS seq, count(*) AS n, min(line_no) AS a, max(line_no) AS b FROM marked GROUP BY doc_id, run
), c AS (
  SELECT cut.*, first_doc, first_seq, first_line FROM cut JOIN f USING (doc_id, seq)
), ends AS (
  SELECT c.doc_id, c.seq, min(x.seq - c.seq) FILTER (WHERE y.line IS NULL OR x.line <> y.line) AS differ, max(x.seq - c.seq) + 1 AS whole
  FROM c JOIN s x ON x.doc_id = c.doc_id AND x.seq >= c.seq LEFT JOIN s y ON y.doc_id = c.first_doc AND y.seq = x.seq - c.seq + c.first_seq GROUP BY c.doc_id, c.seq
), removed AS (
  SELECT doc_id, sum(n) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS said, string_agg(first_doc || ':' || first_line || '+' || coalesce(differ, whole), ',' ORDER BY a) AS kept
  FROM c JOIN ends USING (doc_id, seq) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, coalesce(r.said, '') AS removed_runs, coalesce(r.kept, '') AS kept_runs
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) c USING (doc_id)
LEFT JOIN removed r USING (doc_id)
"""


def op3(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), MIN_LINES)
