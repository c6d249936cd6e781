"""Point and set lookups, expansion, counts, and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import ARTIFACTS

DISPLAY = ("vertex_id", "artifact_id", "role", "generation", "terminal", "content_hash", "trust_state", "auth_state", "parent_count", "lineage_kind", "batch_id", "authority_id")
ATTRIBUTES = ("artifact_id", "role", "generation", "trust_state", "auth_state", "auth_tag")
SUMMARY = ("artifact_id", "vertex_id", "role", "lineage_kind", "generation", "parent_count", "terminal", "content_hash", "trust_state", "authority_id", "batch_id")
WITNESS = ("edge_id", "child_artifact_id", "parent_artifact_id", "kind", "child_generation", "parent_generation", "batch_id")


def by_vertex(artifacts: DataFrame, vertex_id: int | Column, columns: tuple[str, ...] = tuple(f.name for f in ARTIFACTS)) -> DataFrame:
    """One artifact or none; that two rows have the key is an error when the frame is used."""
    found = artifacts.where(F.col("vertex_id") == vertex_id).withColumn("_n", F.count("*").over(Window.partitionBy("vertex_id")))
    twice = F.raise_error(F.concat(F.lit("repeated vertex "), F.col("vertex_id").cast("string"))).cast("boolean")
    return found.where(F.when(F.col("_n") > 1, twice).otherwise(F.lit(True))).select(*columns)


def attributes(artifacts: DataFrame, ids: DataFrame) -> DataFrame:
    """The few attributes that checks of a write ask for, of the artifacts that are stored."""
    return by_ids(artifacts, ids).select(*ATTRIBUTES)


def by_ids(artifacts: DataFrame, ids: DataFrame) -> DataFrame:
    """The artifacts that are asked for; ids that aren't stored are dropped."""
    return artifacts.join(ids.select("artifact_id").distinct(), "artifact_id", "left_semi")


def display(artifacts: DataFrame, columns: tuple[str, ...] = DISPLAY) -> DataFrame:
    return artifacts.select(*columns)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def expand(edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Every edge with its parent's summary; a parent that isn't stored leaves nulls and ``dangling``."""
    parent = artifacts.select(F.col("vertex_id").alias("parent_vertex_id"), F.struct(*(c for c in SUMMARY)).alias("parent"), F.lit(True).alias("_stored"))
    return edges.join(parent, "parent_vertex_id", "left").withColumn("dangling", F.col("_stored").isNull()).drop("_stored")


def between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edges between given ends (``child``, ``parent``)."""
    p = pairs.select(F.col("child").alias("child_artifact_id"), F.col("parent").alias("parent_artifact_id")).distinct()
    return edges.join(p, ["child_artifact_id", "parent_artifact_id"], "left_semi")


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("child_artifact_id").alias("artifact_id")).agg(F.count("*").alias("out_degree"))


def label_counts(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by role and by edge kind."""
    a = artifacts.groupBy(F.concat(F.lit("node:"), "role").alias("label")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.concat(F.lit("edge:"), "kind").alias("label")).agg(F.count("*").alias("n")))


def generation_sizes(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("generation").agg(F.count("*").alias("n"))


def resolve(asked: DataFrame, valid: DataFrame) -> DataFrame:
    """(``child``, ``invalid_parent_ids``, ``n_valid``) of asked (``child``, ``parent``); ``valid`` has ``artifact_id`` of valid artifacts."""
    seen = asked.repartition("parent").distinct().join(valid.select(F.col("artifact_id").alias("parent"), F.lit(True).alias("ok")), "parent", "left")
    return seen.groupBy("child").agg(F.array_sort(F.collect_list(F.when(F.col("ok").isNull(), F.col("parent")))).alias("invalid_parent_ids"), F.count("ok").alias("n_valid"))


def hydration(requested: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The requested (``artifact_id``) that aren't stored; see :func:`mismatched` for those that are stored as something else."""
    return requested.distinct().join(artifacts, "artifact_id", "left_anti").select("artifact_id")


def mismatched(requested: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(``requested``, ``stored``) where the vertex of a requested ``artifact_id`` is stored under another id."""
    from ..functions.columns import vertex_id

    asked = requested.select(F.col("artifact_id").alias("requested")).distinct().withColumn("vertex_id", vertex_id(F.col("requested")))
    return asked.join(artifacts.select("vertex_id", F.col("artifact_id").alias("stored")), "vertex_id").where("requested <> stored").select("requested", "stored")


def edge_set_matches(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """(``child``, ``missing``, ``extra``) from two tables of ``child``, ``parent``: both 0 where the sets agree."""
    both = stored.select("child", "parent").distinct().withColumn("s", F.lit(1)).join(expected.select("child", "parent").distinct().withColumn("e", F.lit(1)), ["child", "parent"], "full_outer")
    return both.groupBy("child").agg(F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra"))


def node_set(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ids of roots and of both ends of edges."""
    ends = edges.select(F.explode(F.array("child_artifact_id", "parent_artifact_id")).alias("artifact_id"))
    return roots.select("artifact_id").unionByName(ends).distinct()


def kind_uniform(edges: DataFrame) -> DataFrame:
    """(``artifact_id``, ``uniform``): whether all edges out of a child share kind, generation and batch."""
    one = lambda c: F.min(c).eqNullSafe(F.max(c))
    return edges.groupBy(F.col("child_artifact_id").alias("artifact_id")).agg((one("kind") & one("child_generation") & one("batch_id")).alias("uniform"))


def generation_conflicts(edges: DataFrame) -> DataFrame:
    """Artifacts that edges give more than one generation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("child_artifact_id").alias("id"), F.col("child_generation").alias("g")), F.struct(F.col("parent_artifact_id").alias("id"), F.col("parent_generation").alias("g")))).alias("x"))
    return ends.groupBy(F.col("x.id").alias("artifact_id")).agg(F.min("x.g").alias("low"), F.max("x.g").alias("high")).where("low < high")


def pair_kinds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(``child_role``, ``parent_role``, ``kinds`` sorted, ``n``) over all edges, which have their ``kind`` and may have ``child_role``; ``nodes`` has ``artifact_id``, ``role``."""
    c = nodes.select(F.col("artifact_id").alias("child_artifact_id"), F.col("role").alias("child_role"))
    p = nodes.select(F.col("artifact_id").alias("parent_artifact_id"), F.col("role").alias("parent_role"))
    known = edges if "child_role" in edges.columns else edges.join(c, "child_artifact_id")
    return known.join(p, "parent_artifact_id").groupBy("child_role", "parent_role").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count("*").alias("n"))
