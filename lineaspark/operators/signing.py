"""Raw nodes and derivations to a signed graph, and the authenticity of what is stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, DERIVED_ROLES, EDGE_KINDS, MAX_PARENTS, SOURCE_TRUST, LineageConfig
from ..functions import columns as C
from ..schema import ARTIFACTS, EDGE_FIELDS, EDGES, NODE_FIELDS, json_parts
from ..sources.snapshots import Scratch


def _typed(names: tuple[str, ...], at: str = "") -> list[tuple[str, Column]]:
    return [(kind, F.col(at + n)) for kind, n in json_parts(names)]


def node_tag(cfg: LineageConfig = DEFAULT, at: str = "") -> Column:
    """The HMAC over all other fields of a node; ``at`` prefixes column names."""
    return C.hmac_sha256(cfg.signing_key, C.json_array("node-v3", *_typed(NODE_FIELDS, at)))


def edge_tag(cfg: LineageConfig = DEFAULT, at: str = "") -> Column:
    return C.hmac_sha256(cfg.signing_key, C.json_array("edge-v2", *_typed(EDGE_FIELDS, at)))


def attestation(artifact_id: Column, content: Column, cfg: LineageConfig = DEFAULT) -> Column:
    """What the trusted connector signs for a source."""
    said = C.json_array("connector-attestation-v1", ("s", artifact_id), ("s", C.sha256_hex(content)), cfg.connector_issuer, cfg.connector_key_id)
    return C.hmac_sha256(cfg.connector_key, said)


def source_fields(artifact_id: Column, content: Column, cfg: LineageConfig = DEFAULT) -> dict[str, Column]:
    """The fields of a trusted source's record, but for its tag, by its id and content; ids and digests of a null are null."""
    fixed = {
        "role": "source", "generation": 0, "terminal": True, "trust_state": "trusted_source", "auth_state": "committed", "writer_id": cfg.writer_id, "writer_key_id": cfg.writer_key_id,
        "gate_id": cfg.gate_id, "parent_count": 0, "lineage_kind": "source", "write_version": 1, "create_only": cfg.create_only, "authority_id": cfg.connector_issuer,
    }
    proof = C.sha256_hex(C.json_array(cfg.connector_issuer, cfg.connector_key_id, ("s", attestation(artifact_id, content, cfg))))
    chosen = C.selector(artifact_id, cfg)
    context = C.sha256_hex(C.json_array("trusted-source-context-v1", ("s", artifact_id), ("s", chosen), ("s", proof)))
    return {k: F.lit(v) for k, v in fixed.items()} | {
        "artifact_id": artifact_id, "vertex_id": C.vertex_id(artifact_id, cfg), "selector": chosen, "content_hash": C.sha256_hex(content), "parent_set_hash": F.sha2(F.lit("[]"), 256),
        "context_id": context, "batch_id": batch_of("source", context, cfg), "authority_proof_hash": proof,
    }


def context_text(cfg: LineageConfig = DEFAULT) -> Column:
    """What a derived artifact's context id covers: columns ``artifact_id``, ``selector``, ``role``, ``generation``, ``kind``, the parents and the writer."""
    c = F.col
    return C.json_array(
        "context-v2", ("s", c("artifact_id")), ("s", c("selector")), ("s", c("role")), ("n", c("generation")), ("s", c("kind")),
        ("n", c("parent_count")), ("s", c("parent_set_hash")), ("a", c("parent_ids")), ("s", c("writer_id")), ("s", c("writer_key_id")),
        ("s", c("gate_id")), ("n", c("write_version")), ("n", c("duplicate_parent_count")),
    )


def context_token(text: Column, context_id: Column, batch_id: Column, cfg: LineageConfig = DEFAULT) -> Column:
    """A context's token covers its fields and then its two ids."""
    inner = F.substring(text, F.lit(1), F.length(text) - 1)
    return C.hmac_sha256(cfg.signing_key, F.concat(inner, F.lit(',"'), context_id, F.lit('","'), batch_id, F.lit('"]')))


def batch_of(kind: str, context_id: Column, cfg: LineageConfig = DEFAULT) -> Column:
    return C.sha256_hex(F.concat(F.lit(f"{cfg.prefix}:{kind}-batch:"), context_id))


def distinct_by(df: DataFrame, key: str) -> DataFrame:
    """Distinct rows by one exchange, by ``key`` alone, which what comes next by that key needs no other for."""
    return df.repartition(key).distinct()


def pairs_of(derivations: DataFrame) -> DataFrame:
    """(``child``, ``parent``) of derivations that are given so, or as lists: (``child``, ``parents``)."""
    return derivations.select("child", "parent" if "parent" in derivations.columns else F.explode("parents").alias("parent"))


def distinct_pairs(derivations: DataFrame) -> DataFrame:
    """Distinct (``child``, ``parent``) by one exchange, by child; lists are exchanged as they are, so a child's id travels once for each of them."""
    return pairs_of(derivations.repartition("child")).distinct()


def parent_sets(derivations: DataFrame) -> DataFrame:
    """(``child``, ``parent_ids`` sorted and distinct, ``parent_count``, ``duplicate_parent_count``, ``parent_set_hash``).

    One exchange, by child: repeats are dropped and parents counted there.  Of a
    child with more than ``MAX_PARENTS`` no more are gathered than that: its set
    and its digest are null.  Lists (see :func:`pairs_of`) are exchanged as they are.
    """
    once = pairs_of(derivations.repartition("child")).groupBy("child", "parent").agg(F.count("*").alias("n"))
    once = once.withColumn("_nth", F.row_number().over(Window.partitionBy("child").orderBy("parent")))
    rows = once.groupBy("child").agg(
        F.count("*").cast("int").alias("parent_count"), F.sum(F.col("n") - 1).cast("int").alias("duplicate_parent_count"),
        F.array_sort(F.collect_list(F.when(F.col("_nth") <= MAX_PARENTS, F.col("parent")))).alias("_some"),
    ).withColumn("parent_ids", F.when(F.col("parent_count") <= MAX_PARENTS, F.col("_some")))
    return rows.select("child", "parent_ids", "parent_count", "duplicate_parent_count", F.when(F.col("parent_ids").isNotNull(), C.parent_set_hash(F.col("parent_ids"))).alias("parent_set_hash"))


def sign(nodes: DataFrame, derivations: DataFrame, cfg: LineageConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(artifacts, edges) with deterministic ids, contexts, batches and tags.

    ``nodes`` has ``artifact_id``, ``role``, ``generation``, ``lineage_kind``,
    ``content``, ``trust_state`` and ``authority_id``; only the content's digest
    is stored.  ``derivations`` are pairs or lists (see :func:`pairs_of`).  A derivation one of whose ends is no node gives no edge, and a
    node with more than ``MAX_PARENTS`` parents is signed without their set,
    which never verifies.
    """
    fixed = [F.lit(cfg.writer_id).alias("writer_id"), F.lit(cfg.writer_key_id).alias("writer_key_id"), F.lit(cfg.gate_id).alias("gate_id"), F.lit(1).alias("write_version"), F.lit(cfg.create_only).alias("create_only")]
    rows = nodes.join(parent_sets(derivations), F.col("artifact_id") == F.col("child"), "left").select(
        *(F.col(c) for c in ("artifact_id", "role", "generation", "lineage_kind", "content", "trust_state", "authority_id")), *fixed,
        (F.col("role") == "source").alias("terminal"), F.coalesce("parent_count", F.lit(0)).alias("parent_count"),
        F.coalesce("parent_ids", F.array().cast("array<string>")).alias("parent_ids"), F.coalesce("duplicate_parent_count", F.lit(0)).alias("duplicate_parent_count"),
        F.coalesce("parent_set_hash", F.lit(None).cast("string"), F.sha2(F.lit("[]"), 256)).alias("parent_set_hash"),
    )
    # digests are made after the exchange, which would multiply by them what it moves
    rows = rows.withColumn("selector", C.selector(F.col("artifact_id"), cfg)).withColumn("content_hash", C.sha256_hex(F.col("content")))
    proof = C.json_array(cfg.connector_issuer, cfg.connector_key_id, ("s", attestation(F.col("artifact_id"), F.col("content"), cfg)))
    rows = rows.withColumn("source_proof", F.when(F.col("terminal"), C.sha256_hex(proof)))
    source = C.json_array("trusted-source-context-v1", ("s", F.col("artifact_id")), ("s", F.col("selector")), ("s", F.col("source_proof")))
    rows = rows.withColumn("kind", F.col("lineage_kind")).withColumn("context_text", context_text(cfg)).withColumn("context_id", C.sha256_hex(F.when(F.col("terminal"), source).otherwise(F.col("context_text"))))
    rows = rows.withColumn("batch_id", F.when(F.col("terminal"), batch_of("source", F.col("context_id"), cfg)).otherwise(batch_of("derived", F.col("context_id"), cfg)))
    token = context_token(F.col("context_text"), F.col("context_id"), F.col("batch_id"), cfg)
    rows = rows.withColumn("authority_proof_hash", F.coalesce("source_proof", C.sha256_hex(token))).withColumn("vertex_id", C.vertex_id(F.col("artifact_id"), cfg)).withColumn("auth_state", F.lit("committed"))
    artifacts = rows.select(*NODE_FIELDS).withColumn("auth_tag", node_tag(cfg)).select(*(F.col(f.name).cast(f.dataType) for f in ARTIFACTS))
    return artifacts, edges_of(artifacts, derivations, cfg)


def edges_of(artifacts: DataFrame, derivations: DataFrame, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """Signed edges of the derivations both of whose ends are artifacts, as these are stored."""
    few = artifacts.select("artifact_id", "vertex_id", "generation", "lineage_kind", "batch_id")
    child = few.select(*(F.col(c).alias(f"c_{c}") for c in few.columns))
    parent = few.select(*(F.col(c).alias(f"p_{c}") for c in few.columns if c not in ("lineage_kind", "batch_id")))
    # parents first: their few fields are narrow, and a child's digests then never travel with each of its edges
    pairs = distinct_by(pairs_of(derivations), "parent").join(parent, F.col("parent") == F.col("p_artifact_id")).join(child, F.col("child") == F.col("c_artifact_id"))
    edges = pairs.select(
        C.edge_id(F.col("child"), F.col("parent"), F.col("c_lineage_kind"), cfg).alias("edge_id"), F.col("child").alias("child_artifact_id"), F.col("parent").alias("parent_artifact_id"),
        F.col("c_lineage_kind").alias("kind"), F.col("c_generation").alias("child_generation"), F.col("p_generation").alias("parent_generation"),
        F.lit(cfg.writer_id).alias("writer_id"), F.lit(cfg.writer_key_id).alias("writer_key_id"), F.lit(cfg.gate_id).alias("gate_id"), F.col("c_batch_id").alias("batch_id"), F.lit(1).alias("write_version"),
        F.col("c_vertex_id").alias("child_vertex_id"), F.col("p_vertex_id").alias("parent_vertex_id"),
    )
    return edges.withColumn("auth_tag", edge_tag(cfg)).select(*(F.col(f.name).cast(f.dataType) for f in EDGES))


def authentic_node(cfg: LineageConfig = DEFAULT, state: str = "committed", at: str = "") -> Column:
    """Every stored field as this writer would have written it, the tag included; never null."""
    c = lambda n: F.col(at + n)
    ok = (
        (c("writer_id") == cfg.writer_id) & (c("writer_key_id") == cfg.writer_key_id) & (c("gate_id") == cfg.gate_id) & (c("auth_state") == state)
        & (c("create_only") == cfg.create_only) & (c("write_version") == 1) & C.is_hex64(c("batch_id")) & (c("generation") >= 0) & (c("parent_count") >= 0)
        & (c("auth_tag") == node_tag(cfg, at))
    )
    return F.coalesce(ok, F.lit(False))


def authentic_edge(cfg: LineageConfig = DEFAULT, at: str = "") -> Column:
    c = lambda n: F.col(at + n)
    ok = (
        (c("writer_id") == cfg.writer_id) & (c("writer_key_id") == cfg.writer_key_id) & (c("gate_id") == cfg.gate_id)
        & (c("write_version") == 1) & C.is_hex64(c("batch_id")) & (c("auth_tag") == edge_tag(cfg, at))
    )
    return F.coalesce(ok, F.lit(False))


def identity_ok(cfg: LineageConfig = DEFAULT, at: str = "") -> Column:
    a = F.col(at + "artifact_id")
    return F.coalesce(C.is_artifact_id(a) & (F.col(at + "vertex_id") == C.vertex_id(a, cfg)) & (F.col(at + "selector") == C.selector(a, cfg)), F.lit(False))


#: What verification reads of nodes and edges, once their tags are checked.
_CHECKED = ("artifact_id", "vertex_id", "role", "generation", "terminal", "lineage_kind", "batch_id", "write_version", "trust_state", "parent_count", "parent_set_hash")
_JOINED = ("edge_id", "child_artifact_id", "parent_artifact_id", "kind", "child_generation", "parent_generation", "batch_id", "write_version", "child_vertex_id", "parent_vertex_id")


def _other(vertex: Column, named: Column, met: Column, cfg: LineageConfig) -> Column:
    """Whether an edge's end ``named`` and a node ``met`` under the same vertex id are two artifacts: both ids have that digest.  Of tens of millions of ids some share their 48 bits."""
    return F.coalesce((named != met) & (C.vertex_id(named, cfg) == vertex) & (C.vertex_id(met, cfg) == vertex), F.lit(False))


def checked(artifacts: DataFrame, edges: DataFrame, cfg: LineageConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Local verdicts, made once a node and once an edge whatever the number of roots.

    Nodes get ``node_ok`` (identity, authenticity, generation bound),
    ``structure_ok`` (terminal or derived shape against the stored edges) and
    their ``parents``; edges (``child``, ``parent``, generations, ``edge_ok``)
    also cover the parent's authenticity, and have ``parent_missing`` where it
    isn't stored.  The parents of a child that has more than ``MAX_PARENTS``
    edges are never gathered: its structure is wrong in any case.
    """
    scratch = Scratch(artifacts.sparkSession, "checked")
    ok = identity_ok(cfg) & authentic_node(cfg) & F.coalesce(F.col("generation") <= cfg.max_generation, F.lit(False))
    node = scratch.table(artifacts.withColumn("node_ok", ok).select(*_CHECKED, "node_ok"), "nodes")
    ends = node.select(*(F.col(c).alias(f"_{c}") for c in ("artifact_id", "vertex_id", "generation", "lineage_kind", "batch_id", "write_version", "node_ok")))
    child = ends.drop("_node_ok").select(*(F.col(c).alias(f"c{c}") for c in ends.columns if c != "_node_ok"))
    parent = ends.select(*(F.col(f"_{c}").alias(f"p_{c}") for c in ("artifact_id", "vertex_id", "generation", "node_ok")))
    # what an edge says of its child is compared where the child is met, and only the answer goes on to the parent; batches meet as bytes, half
    # the size of their text: an edge whose batch isn't such a text has no tag that holds
    short = F.when(C.is_hex64(F.col("batch_id")), F.unhex("batch_id"))
    child = child.withColumn("c_batch_id", F.when(C.is_hex64(F.col("c_batch_id")), F.unhex("c_batch_id")))
    e = edges.withColumn("_tag_ok", authentic_edge(cfg)).select("_tag_ok", *_JOINED).withColumn("batch_id", short)
    e = e.join(child, (F.col("child_vertex_id") == F.col("c_vertex_id")) & ~_other(F.col("c_vertex_id"), F.col("child_artifact_id"), F.col("c_artifact_id"), cfg))
    own = (
        F.col("_tag_ok") & (F.col("edge_id") == C.edge_id(F.col("c_artifact_id"), F.col("parent_artifact_id"), F.col("c_lineage_kind"), cfg))
        & (F.col("kind") == F.col("c_lineage_kind")) & (F.col("child_artifact_id") == F.col("c_artifact_id")) & (F.col("child_generation") == F.col("c_generation"))
        & (F.col("batch_id") == F.col("c_batch_id")) & (F.col("write_version") == F.col("c_write_version")) & (F.col("parent_generation") < F.col("c_generation"))
    )
    e = e.select("c_artifact_id", "c_generation", "parent_artifact_id", "parent_vertex_id", "parent_generation", F.coalesce(own, F.lit(False)).alias("_own"))
    e = e.join(parent, (F.col("parent_vertex_id") == F.col("p_vertex_id")) & ~_other(F.col("p_vertex_id"), F.col("parent_artifact_id"), F.col("p_artifact_id"), cfg), "left")
    good = F.col("p_node_ok") & F.col("_own") & (F.col("parent_artifact_id") == F.col("p_artifact_id")) & (F.col("parent_generation") == F.col("p_generation"))
    e = scratch.table(e.select(
        F.col("c_artifact_id").alias("child"), F.coalesce("p_artifact_id", "parent_artifact_id").alias("parent"), F.coalesce(good, F.lit(False)).alias("edge_ok"), F.col("p_artifact_id").isNull().alias("parent_missing"),
        F.col("c_generation").alias("child_generation"), F.col("p_generation").alias("parent_generation"),
    ), "links")
    nth = F.row_number().over(Window.partitionBy("child").orderBy("parent"))
    out = e.select("child", "parent", "parent_missing", "edge_ok").repartition("child").withColumn("_nth", nth).groupBy("child").agg(
        F.count("*").alias("_n"), F.bool_or("parent_missing").alias("dangling"), F.bool_and("edge_ok").alias("edges_ok"),
        F.array_sort(F.collect_list(F.when(F.col("_nth") <= MAX_PARENTS, F.col("parent")))).alias("parents"),
    ).withColumn("parents", F.when(F.col("_n") <= MAX_PARENTS, F.col("parents")))
    n = F.coalesce(F.col("_n"), F.lit(0))
    node = node.join(out, F.col("artifact_id") == F.col("child"), "left").drop("child")
    source = (F.col("role") == "source") & (F.col("generation") == 0) & (F.col("parent_count") == 0) & (F.col("parent_set_hash") == F.sha2(F.lit("[]"), 256)) & (F.col("lineage_kind") == "source") & F.col("trust_state").isin(*SOURCE_TRUST) & (n == 0)
    derived = F.col("role").isin(*DERIVED_ROLES) & (F.col("trust_state") == "derived") & (F.col("generation") > 0) & (F.col("parent_count") > 0) & F.col("lineage_kind").isin(*EDGE_KINDS) & (n == F.col("parent_count")) & F.coalesce(F.col("parent_set_hash") == F.sha2(F.to_json("parents"), 256), F.lit(False))
    node = node.withColumn("structure_ok", F.coalesce(F.when(F.col("terminal"), source).otherwise(derived), F.lit(False)))
    return node.withColumn("edges_ok", F.coalesce("edges_ok", F.lit(True))).withColumn("dangling", F.coalesce("dangling", F.lit(False))).drop("_n"), e


def few(ids: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """A written table of ids, to be broadcast if it is counted to be small."""
    return F.broadcast(ids) if ids.count() <= broadcast_rows else ids


def of_vertices(artifacts: DataFrame, edges: DataFrame, children: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The artifacts and edges that the verdicts of ``children`` (a written table of ``vertex_id``) depend on: these, their edges and their parents."""
    own = edges.join(few(children).select(F.col("vertex_id").alias("child_vertex_id")), "child_vertex_id", "left_semi").select(*edges.columns)
    own = scratch.table(own, "own-edges")
    every = scratch.table(children.select("vertex_id").unionByName(own.select(F.col("parent_vertex_id").alias("vertex_id"))).distinct(), "ends")
    return artifacts.join(few(every), "vertex_id", "left_semi").select(*artifacts.columns), own


def ancestry(artifacts: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int, cfg: LineageConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The artifacts and edges that a verification of ``roots`` (``artifact_id``) to ``max_depth`` can ask for, found by ids alone.

    Verdicts made of these are those made of the whole store, for all nodes
    within the depth; no tag is looked at on the way.
    """
    scratch = Scratch(artifacts.sparkSession, "ancestry")
    level = scratch.table(roots.select(C.vertex_id(F.col("artifact_id"), cfg).alias("vertex_id")).where("vertex_id is not null").distinct(), "level-0")
    levels = [level]
    for d in range(1, max_depth + 1):
        up = edges.join(few(level).select(F.col("vertex_id").alias("child_vertex_id")), "child_vertex_id", "left_semi").select(F.col("parent_vertex_id").alias("vertex_id")).distinct()
        for seen in levels:
            up = up.join(seen, "vertex_id", "left_anti")
        level = scratch.table(up, f"level-{d}")
        if level.isEmpty():
            break
        levels.append(level)
    return of_vertices(artifacts, edges, scratch.table(reduce(DataFrame.unionByName, levels), "reached"), scratch)


def rechecked(nodes: DataFrame, links: DataFrame, artifacts: DataFrame, edges: DataFrame, changed: DataFrame, cfg: LineageConfig = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, ``artifact_id`` of all that were checked anew), as :func:`checked` gives them for ``artifacts`` and ``edges``.

    ``nodes`` and ``links`` are what it gave for the store as it was, and
    ``changed`` (``artifact_id``) are the artifacts that were added, taken away
    or altered since, or whose edges were.  These are checked, and their children,
    whose edges say whether a parent is there and authentic; the work follows
    the change and not the store.
    """
    scratch = Scratch(artifacts.sparkSession, "rechecked")
    changed = few(scratch.table(changed.select("artifact_id").distinct(), "changed"))
    touched = nodes.join(changed, "artifact_id", "left_semi").select("vertex_id").unionByName(artifacts.join(changed, "artifact_id", "left_semi").select("vertex_id"))
    touched = scratch.table(touched.where("vertex_id is not null").distinct(), "touched")
    below = edges.join(few(touched).select(F.col("vertex_id").alias("parent_vertex_id")), "parent_vertex_id", "left_semi").select(F.col("child_vertex_id").alias("vertex_id"))
    again = scratch.table(touched.unionByName(below).distinct(), "again")
    new, new_links = checked(*of_vertices(artifacts, edges, again, scratch), cfg)
    new = scratch.table(new.join(few(again), "vertex_id", "left_semi").select(*nodes.columns), "nodes")
    ids = nodes.join(few(again), "vertex_id", "left_semi").select("artifact_id").unionByName(new.select("artifact_id")).unionByName(changed.select("artifact_id"))
    ids = scratch.table(ids.distinct(), "ids")
    kept = nodes.join(few(again), "vertex_id", "left_anti").select(*nodes.columns)
    kept_links = links.join(few(ids).select(F.col("artifact_id").alias("child")), "child", "left_anti").select(*links.columns)
    return kept.unionByName(new), kept_links.unionByName(new_links.select(*links.columns)), ids
