"""Any JSON as rows of path and value, and contracts on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.snapshots import Scratch


def _step(path: Column, key: Column, pos: Column) -> Column:
    plain = key.rlike(r"^[A-Za-z0-9_-]+\z")
    return F.when(key.isNull(), F.concat(path, F.lit("["), pos.cast("string"), F.lit("]"))).when(plain, F.concat(path, F.lit("."), key)).otherwise(F.concat(path, F.to_json(F.array(key))))


def paths(reports: DataFrame) -> DataFrame:
    """(``name``, ``path``, ``value``) of everything in JSON texts (``name``, ``raw``): objects, lists and what is in them, at any depth.

    The whole is ``$``, a field ``.name`` (or ``["a b"]`` where it isn't of letters,
    digits, ``_`` and ``-``) and an item ``[0]``; values are JSON text with
    sorted names.  A text that is null, no JSON, or repeats a field's name gives no
    rows.  A level of nesting is one traversal, which is written.
    """
    spark, scratch = reports.sparkSession, Scratch(reports.sparkSession, "json-paths")
    level = reports.select("name", F.lit("$").alias("path"), F.to_json(F.try_parse_json("raw")).alias("value")).where("value is not null")
    levels: list[DataFrame] = []
    while True:
        levels.append(scratch.table(level, f"level-{len(levels)}"))
        inner = levels[-1].where(F.substring("value", 1, 1).isin("{", "[") & (F.length("value") > 2))
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        each = inner.select("name", "path", F.parse_json("value").alias("_v")).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        level = each.select("name", _step(F.col("path"), F.col("key"), F.col("pos")).alias("path"), F.to_json("value").alias("value"))


def contract(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(``name``, ``path``, ``ok``): whether a report's value at a path is there once and is the expected one, as JSON text.

    ``found`` is what :func:`paths` gives, ``expected`` has ``name``, ``path`` and ``value``.
    """
    # a semi join needs no distinct keys, whose set a task would hold for all rows that it reads
    got = found.join(expected.select("name", "path"), ["name", "path"], "left_semi").groupBy("name", "path").agg(F.count("*").alias("n"), F.min("value").alias("got"))
    return expected.join(got, ["name", "path"], "left").select("name", "path", F.coalesce((F.col("n") == 1) & (F.col("got") == F.col("value")), F.lit(False)).alias("ok"))
