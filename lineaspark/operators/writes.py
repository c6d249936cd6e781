"""Writes as transforms of immutable snapshots: upserts, compare-and-set, staged commits, replays and tampering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import ATTESTATION_FIELDS, DEFAULT, DERIVED_ROLES, EDGE_KINDS, MAX_CONTENT_BYTES, MAX_PARENTS, PRODUCER_FIELDS, SOURCE_FIELDS, LineageConfig
from ..functions import columns as C, surrogates
from ..schema import ARTIFACTS, EDGES, NODE_FIELDS
from ..sources.snapshots import Scratch
from ..sources.versions import Versions
from .signing import attestation, authentic_edge, authentic_node, batch_of, checked, context_text, context_token, edge_tag, few, node_tag, of_vertices, source_fields


def create_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, and new ones whose key isn't stored; of new rows with one key the least stays."""
    once = new.groupBy(key).agg(F.min(F.struct(*(c for c in new.columns if c != key))).alias("_r")).select(key, "_r.*")
    return old.unionByName(once.join(old, key, "left_anti").select(*old.columns))


def update_if_newer(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Of all rows of a key the one of the highest version; the stored one wins ties."""
    rest = [c for c in old.columns if c != key]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(version), -F.col("_new"))).alias("_r"))
    return best.select(key, "_r.*").select(*old.columns)


def upsert_edges(old: DataFrame, new: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Edges whose ends are both stored, created only; the others are dropped."""
    ids = artifacts.select("vertex_id")
    ends = new.join(ids.withColumnRenamed("vertex_id", "child_vertex_id"), "child_vertex_id", "left_semi").join(ids.withColumnRenamed("vertex_id", "parent_vertex_id"), "parent_vertex_id", "left_semi")
    return create_only(old, ends, "edge_id")


def compare_and_set(rows: DataFrame, expected: DataFrame, key: str, on: tuple[str, ...], new: dict[str, str]) -> DataFrame:
    """Rows that agree with ``expected`` (``key`` and ``on``) get the columns that ``new`` names from it; others stay."""
    e = expected.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in on), *(F.col(v).alias(f"_new_{c}") for c, v in new.items()))
    match = F.coalesce(F.col("_k").isNotNull() & F.struct(*on).eqNullSafe(F.struct(*(F.col(f"_{c}") for c in on))), F.lit(False))
    both = rows.join(e, F.col(key) == F.col("_k"), "left")
    return both.select(*(F.when(match, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns))


def replay_or_conflict(stored: DataFrame, wanted: DataFrame, valid: DataFrame) -> DataFrame:
    """(``artifact_id``, ``detail``) of wanted records against stored ones; ``valid`` has ``artifact_id`` and boolean ``value``."""
    a = stored.select(F.col("artifact_id"), F.struct(*NODE_FIELDS).alias("s"))
    b = wanted.select(F.col("artifact_id"), F.struct(*NODE_FIELDS).alias("w"))
    rows = b.join(a, "artifact_id", "left").join(valid.select("artifact_id", "value"), "artifact_id", "left")
    detail = F.when(F.col("s").isNull(), "WRITE_COMMITTED").when(~F.col("s").eqNullSafe(F.col("w")), "ARTIFACT_IMMUTABILITY_CONFLICT").when(~F.coalesce("value", F.lit(False)), "INVALID_COMMITTED_ANCESTRY").otherwise("WRITE_REPLAYED")
    return rows.select("artifact_id", detail.alias("detail"))


def producer_output(raw: Column) -> Column:
    """Why a producer's output is refused, or null: it may have a content, a string, and nothing else."""
    v = F.try_parse_json(surrogates.guarded(raw))
    extra = F.array_except(C.json_keys(v), F.array(*map(F.lit, PRODUCER_FIELDS)))
    content = surrogates.shown(C.json_text(v, "$.content"))
    return F.when(extra.isNull(), "INVALID_PRODUCER_OUTPUT").when(F.size(extra) > 0, "UNTRUSTED_CONTROL_FIELD").when(content.isNull(), "INVALID_ARTIFACT_CONTENT").when(F.octet_length(content) > MAX_CONTENT_BYTES, "ARTIFACT_CONTENT_TOO_LARGE")


def parse_sources(raw: DataFrame) -> DataFrame:
    """``raw`` (JSON text) registrations with ``artifact_id``, ``content``, ``issuer``, ``key_id``, ``signature``, and ``fault``, null if their shape is right."""
    v, listed = F.col("_v"), lambda names: F.array(*map(F.lit, names))
    rows = raw.withColumn("_v", F.try_parse_json(surrogates.guarded(F.col("raw"))))
    keys, inner = C.json_keys(v), C.json_keys(v, "$.attestation")
    rows = rows.select(
        "*", *(surrogates.shown(C.json_text(v, f"$.{f}")).alias(name) for f, name in (("id", "artifact_id"), ("content", "content"), *((f"attestation.{f}", f) for f in ATTESTATION_FIELDS))),
        F.array_except(keys, listed(SOURCE_FIELDS)).alias("_extra"), (F.array_sort(inner) == listed(ATTESTATION_FIELDS)).alias("_whole"),
    )
    fault = (
        F.when(F.col("_extra").isNull(), "INVALID_SOURCE_INPUT").when(F.size("_extra") > 0, "UNTRUSTED_CONTROL_FIELD").when(~C.is_artifact_id(F.col("artifact_id")), "INVALID_ARTIFACT_ID")
        .when(~F.coalesce(F.octet_length("content") <= MAX_CONTENT_BYTES, F.lit(False)), "INVALID_ARTIFACT_CONTENT")
        .when(~F.coalesce(F.col("_whole") & F.col("issuer").isNotNull() & F.col("key_id").isNotNull() & F.col("signature").isNotNull(), F.lit(False)), "INVALID_SOURCE_ATTESTATION")
    )
    return rows.withColumn("fault", fault).drop("_v", "_extra", "_whole")


def registrations(sources: DataFrame, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """(``request``, ``detail``, the fields of ``ARTIFACTS``) of parsed registrations (see :func:`parse_sources`): the record that each asks for, or why it is refused.

    The connector's signature must cover id and content.  ``detail`` is null where a record goes on.
    """
    signed = (F.col("issuer") == cfg.connector_issuer) & (F.col("key_id") == cfg.connector_key_id) & (F.col("signature") == attestation(F.col("artifact_id"), F.col("content"), cfg))
    detail = F.when(F.col("fault").isNotNull(), F.col("fault")).when(~F.coalesce(signed, F.lit(False)), "SOURCE_ATTESTATION_INVALID")
    fields = source_fields(F.col("artifact_id"), F.col("content"), cfg)
    rows = sources.select("request", detail.alias("detail"), *(fields[f].alias(f) for f in NODE_FIELDS)).withColumn("auth_tag", node_tag(cfg))
    return rows.select("request", "detail", *(F.col(f.name).cast(f.dataType) for f in ARTIFACTS))


def _standing(wanted: DataFrame, stored: DataFrame, edges: DataFrame, cfg: LineageConfig) -> DataFrame:
    """(``vertex_id``, ``_stored`` record, ``_whole``) of what is stored where ``wanted`` would be; ``_stored`` is null if its tag doesn't hold or the vertex is there twice.

    ``_whole`` says whether its structure and edges are as verification wants them.  Only these vertices are read and verified.
    """
    scratch = Scratch(wanted.sparkSession, "standing")
    ids = scratch.table(wanted.select("vertex_id").where("vertex_id is not null").distinct(), "ids")
    some, own = of_vertices(stored, edges, ids, scratch)
    some = scratch.table(some, "some")
    nodes = checked(some, own, cfg)[0].groupBy("vertex_id").agg(F.bool_and(F.col("node_ok") & F.col("structure_ok") & F.col("edges_ok") & ~F.col("dangling")).alias("_whole"))
    record = F.when(authentic_node(cfg), F.struct(*NODE_FIELDS))
    here = some.join(few(ids), "vertex_id", "left_semi").select("vertex_id", record.alias("_r")).groupBy("vertex_id").agg(F.count("*").alias("_n"), F.first("_r").alias("_r"))
    return scratch.table(here.join(nodes, "vertex_id", "left").select("vertex_id", F.when(F.col("_n") == 1, F.col("_r")).alias("_stored"), F.coalesce("_whole", F.lit(False)).alias("_whole"), F.lit(True).alias("_there")), "standing")


def plan_registrations(asked: DataFrame, stored: DataFrame, edges: DataFrame, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """(``request``, ``detail``, the record, ``first``: the request whose record counts) of :func:`registrations`; ``detail`` is null where a record is to be written.

    A record that is stored must be the very one in all its signed fields, its
    tag must hold, and it must still verify.  Of several of a batch that ask for one artifact the
    first writes, and the others are compared with what it writes.
    """
    scratch = Scratch(asked.sparkSession, "registrations")
    rows = scratch.table(asked, "asked")
    open_, record = rows.where("detail is null"), F.struct(*NODE_FIELDS)
    first = open_.groupBy("vertex_id").agg(F.min_by(record, "request").alias("_first"), F.min("request").alias("first"))
    old = _standing(open_, stored, edges, cfg)
    out = rows.join(first, "vertex_id", "left").join(old, "vertex_id", "left")
    detail = (
        F.when(F.col("detail").isNotNull(), F.col("detail"))
        .when(F.col("_there"), F.when(~F.col("_stored").eqNullSafe(record), "ARTIFACT_IMMUTABILITY_CONFLICT").when(~F.col("_whole"), "INVALID_COMMITTED_ANCESTRY").otherwise("WRITE_REPLAYED"))
        .when(F.col("request") > F.col("first"), F.when(F.col("_first").eqNullSafe(record), "WRITE_REPLAYED").otherwise("ARTIFACT_IMMUTABILITY_CONFLICT"))
    )
    later = F.coalesce(F.col("_there"), F.lit(False))
    return scratch.table(out.select("request", detail.alias("detail"), *(f.name for f in ARTIFACTS), F.when(~later & F.col("detail").isNull(), F.col("first")).alias("first")), "plan")


def new_records(plan: DataFrame) -> DataFrame:
    """The artifacts that a plan writes."""
    return plan.where("detail is null").select(*(f.name for f in ARTIFACTS))


def confirm_registrations(plan: DataFrame, stored: DataFrame, edges: DataFrame, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """(``request``, ``artifact_id``, ``detail``) of all registrations, where ``stored`` and ``edges`` are read back after the new records were written.

    A record must be there as it was written and verify; if it isn't, neither it
    nor a replay of it within the batch has been committed.
    """
    written = plan.where("detail is null")
    found = written.join(_standing(written, stored, edges, cfg), "vertex_id", "left")
    good = found.select(F.col("request").alias("first"), F.coalesce(F.col("_stored").eqNullSafe(F.struct(*NODE_FIELDS)) & F.col("_whole"), F.lit(False)).alias("_good"))
    rows = plan.join(good, "first", "left")
    lost = F.coalesce(~F.col("_good"), F.lit(False)) & (F.col("detail").isNull() | (F.col("detail") == "WRITE_REPLAYED"))
    return rows.select("request", "artifact_id", F.when(lost, "SOURCE_COMMIT_VERIFICATION_FAILED").otherwise(F.coalesce("detail", F.lit("WRITE_COMMITTED"))).alias("detail"))


def register(sources: DataFrame, store: Versions, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """(``request``, ``artifact_id``, ``detail``) of parsed registrations, written to the next version of a store that has ``artifacts`` and ``edges``.

    The batch is planned against the latest version, its new records are
    published on top of that one, and then read back.  If another version came
    meanwhile nothing is written and the error is ``StaleVersion``: plan again.
    """
    base = store.list()[-1]
    at = lambda v: (store.read("artifacts", ARTIFACTS, v), store.read("edges", EDGES, v))
    plan = plan_registrations(registrations(sources, cfg), *at(base), cfg)
    after = store.commit({"artifacts": new_records(plan)}, base=base)
    return confirm_registrations(plan, *at(after), cfg)


def register_sources(sources: DataFrame, stored: DataFrame, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """(``artifact_id``, ``detail``) of what would become of parsed registrations against stored artifacts without edges, in no order of their own."""
    spark = sources.sparkSession
    if "request" not in sources.columns:
        sources = Scratch(spark, "sources").table(sources.withColumn("request", F.monotonically_increasing_id()), "sources")
    plan = plan_registrations(registrations(sources, cfg), stored, spark.createDataFrame([], EDGES), cfg)
    return plan.select("artifact_id", F.coalesce("detail", F.lit("WRITE_COMMITTED")).alias("detail"))


#: Columns of a prepared context.
CONTEXT = ("artifact_id", "selector", "role", "generation", "kind", "parent_count", "parent_set_hash", "parent_ids", "writer_id", "writer_key_id", "gate_id", "write_version", "duplicate_parent_count", "context_id", "batch_id", "token")


def prepare(asked: DataFrame, artifacts: DataFrame, valid: DataFrame, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """(``detail`` and the columns of ``CONTEXT``) of asked transformations (see :func:`observed`); of a refused one only ``artifact_id``, ``role``, ``kind`` and what was counted."""
    return contexts(observed(asked, artifacts, valid, cfg), cfg).select("detail", *CONTEXT)


def observed(asked: DataFrame, artifacts: DataFrame, valid: DataFrame, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """What is observed of asked transformations and whether they may be prepared, without the digests, which are many times its size and which :func:`contexts` makes of it.

    ``asked`` has ``artifact_id``, ``role``, ``kind`` and ``parent``, a row for
    each observed parent; ``valid`` has ``artifact_id`` and boolean ``value``
    (see ``closure.valid_closures``).  Parents are gathered only where there
    are at most ``MAX_PARENTS``.  A parent that is stored twice can't be resolved.
    """
    key = ["artifact_id", "role", "kind"]
    facts = artifacts.groupBy(F.col("artifact_id").alias("parent")).agg(F.count("*").alias("stored"), F.max("generation").alias("g")).join(valid.groupBy(F.col("artifact_id").alias("parent")).agg(F.bool_and("value").alias("ok")), "parent", "left")
    # each observed parent meets its facts, and then once its child: repeats, counts and sets are made there
    once = asked.join(facts, "parent", "left").repartition("artifact_id").groupBy(*key, "parent").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("stored", "g", "ok")))
    once = once.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy("parent")))
    out = once.groupBy(*key).agg(
        F.sum("n").alias("observed"), F.count("*").alias("distinct_"), F.bool_and(C.is_artifact_id(F.col("parent"))).alias("good"), F.bool_or(F.col("parent").eqNullSafe(F.col("artifact_id"))).alias("self"),
        F.array_sort(F.collect_list(F.when(F.col("_nth") <= MAX_PARENTS, F.col("parent")))).alias("parent_ids"), (F.max("g") + 1).alias("generation"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"), F.bool_or(F.coalesce(F.col("stored") > 1, F.lit(False))).alias("twice"),
    )
    fit = F.col("good") & (F.col("observed") <= MAX_PARENTS)
    named = fit & F.col("artifact_id").isNotNull() & F.col("role").isNotNull() & F.col("kind").isNotNull()
    out = out.withColumns({c: F.when(named, F.col(c)) for c in ("parent_ids", "generation", "ok", "twice")})
    detail = (
        F.when(~C.is_artifact_id(F.col("artifact_id")), "INVALID_ARTIFACT_ID").when(~F.coalesce(F.col("role").isin(*DERIVED_ROLES), F.lit(False)), "INVALID_DERIVED_ROLE").when(~F.coalesce(F.col("kind").isin(*EDGE_KINDS), F.lit(False)), "INVALID_EDGE_KIND")
        .when(~fit, "INVALID_OBSERVED_PARENTS").when(F.col("self"), "SELF_PARENT").when(F.col("twice"), "PARENT_RESOLUTION_FAILED").when(~F.coalesce("ok", F.lit(False)), "PARENT_NOT_AUTHENTIC")
        .when(F.col("generation") > cfg.max_generation, "GENERATION_CAP_EXCEEDED").otherwise("CONTEXT_PREPARED")
    )
    return out.select(detail.alias("detail"), *key, F.col("generation").cast("int").alias("generation"), F.col("distinct_").cast("int").alias("parent_count"), "parent_ids", (F.col("observed") - F.col("distinct_")).cast("int").alias("duplicate_parent_count"))


def contexts(rows: DataFrame, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """The rows of :func:`observed` with all columns of ``CONTEXT``."""
    ready = F.col("detail") == "CONTEXT_PREPARED"
    out = rows.withColumns({
        "selector": C.selector(F.col("artifact_id"), cfg), "parent_set_hash": F.when(F.col("parent_ids").isNotNull(), C.parent_set_hash(F.col("parent_ids"))),
        "writer_id": F.lit(cfg.writer_id), "writer_key_id": F.lit(cfg.writer_key_id), "gate_id": F.lit(cfg.gate_id), "write_version": F.lit(1),
    })
    out = out.withColumn("_text", context_text(cfg)).withColumn("context_id", F.when(ready, C.sha256_hex(F.col("_text")))).withColumn("batch_id", batch_of("derived", F.col("context_id"), cfg))
    return out.withColumn("token", context_token(F.col("_text"), F.col("context_id"), F.col("batch_id"), cfg)).drop("_text")


#: Parts by which kinds of ids are told apart.
_KINDS = 64


def _kinds_of(*ids: DataFrame) -> Callable[[str], Column]:
    """Whether an id may be of a kind, what stands before its first slash, that some of ``ids`` (frames of one column) is of: others needn't be exchanged to find that they aren't among them."""
    part = lambda c: F.pmod(F.xxhash64(F.substring_index(c, "/", 1)), F.lit(_KINDS))
    found = {r[0] for df in ids for r in df.select(part(F.col(df.columns[0]))).distinct().collect()}  # at most _KINDS
    return lambda c: part(F.col(c)).isin(*found) if found else F.lit(False)


def _digest(fields) -> Column:
    """A digest of all these fields, nulls included: records that are only compared move as this."""
    return F.unhex(F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256))


def valid_context(cfg: LineageConfig = DEFAULT) -> Column:
    """Whether the columns of ``CONTEXT`` are a context that this writer prepared; never null."""
    c = F.col
    ids = c("parent_ids")
    text = context_text(cfg)
    ok = (
        C.is_artifact_id(c("artifact_id")) & (c("selector") == C.selector(c("artifact_id"), cfg)) & c("role").isin(*DERIVED_ROLES) & c("kind").isin(*EDGE_KINDS)
        & F.size(ids).between(1, MAX_PARENTS) & (F.size(ids) == c("parent_count")) & (ids == F.array_sort(F.array_distinct(ids))) & ~F.array_contains(ids, c("artifact_id"))
        & (c("parent_set_hash") == C.parent_set_hash(ids)) & (c("writer_id") == cfg.writer_id) & (c("writer_key_id") == cfg.writer_key_id) & (c("gate_id") == cfg.gate_id) & (c("write_version") == 1)
        & (c("duplicate_parent_count") >= 0) & c("generation").between(1, cfg.max_generation) & (c("context_id") == C.sha256_hex(text)) & (c("batch_id") == batch_of("derived", c("context_id"), cfg))
        & (c("token") == context_token(text, c("context_id"), c("batch_id"), cfg))
    )
    return F.coalesce(ok, F.lit(False))


def stage(requests: DataFrame, artifacts: DataFrame, edges: DataFrame, valid: DataFrame, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """What becomes of asked writes before anything is written: ``request``, ``detail`` (null if the write goes on), the record's fields and ``parent_ids``.

    ``requests`` have ``request`` (a number that orders them), the columns of
    ``CONTEXT`` and ``raw``, the producer's output.  Of several that may write
    one artifact the first does; the others are compared with what it writes.
    Artifacts that are stored as committed are replayed or conflict.  What is
    decided moves without the records, which are made where the requests lie:
    if these are dealt by ``request``, records aren't exchanged at all.
    """
    scratch = Scratch(requests.sparkSession, "stage")
    rows = requests.withColumn("_fault", producer_output(F.col("raw"))).withColumn("_context", valid_context(cfg)).withColumn("content_hash", C.sha256_hex(surrogates.shown(C.json_text(F.try_parse_json(surrogates.guarded(F.col("raw"))), "$.content"))))
    rows = rows.withColumns({
        "vertex_id": C.vertex_id(F.col("artifact_id"), cfg), "terminal": F.lit(False), "trust_state": F.lit("derived"), "auth_state": F.lit("committed"), "lineage_kind": F.col("kind"),
        "create_only": F.lit(cfg.create_only), "authority_id": F.lit(cfg.writer_id), "authority_proof_hash": C.sha256_hex(F.col("token")),
    })
    said = _digest([f for f in NODE_FIELDS if f != "auth_state"])  # by all but their state
    good = F.col("_fault").isNull() & F.col("_context")
    asked = scratch.table(rows.select("request", "artifact_id", "generation", "parent_count", "_fault", "_context", F.when(good, F.col("parent_ids")).alias("parent_ids"), F.when(good, said).alias("_made")), "asked")
    each = asked.where("_fault is null and _context").select("request", F.explode("parent_ids").alias("parent"))
    near = _kinds_of(each.select("parent"))
    facts = artifacts.where(near("artifact_id")).select(F.col("artifact_id").alias("parent"), F.col("generation").alias("g")).join(valid.where(near("artifact_id")).select(F.col("artifact_id").alias("parent"), F.col("value").alias("ok")), "parent", "left")
    parents = each.join(facts, "parent", "left").groupBy("request").agg((F.max("g") + 1).alias("_g"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("_ok"))
    detail = (
        F.when(F.col("_fault").isNotNull(), F.col("_fault")).when(~F.col("_context"), "INVALID_TRANSFORMATION_CONTEXT").when(~F.coalesce("_ok", F.lit(False)), "PARENT_NOT_AUTHENTIC")
        .when(~F.coalesce(F.col("_g") == F.col("generation"), F.lit(False)), "CONTEXT_GENERATION_MISMATCH")
    )
    asked = scratch.table(asked.drop("parent_ids").join(parents, "request", "left").select("request", detail.alias("_detail"), "artifact_id", "parent_count", "_made"), "decided")
    # only what the plan asks for is verified
    ids = scratch.table(asked.select("artifact_id").distinct(), "ids")
    mine, ids = _kinds_of(ids), few(ids)
    artifacts, edges, valid = artifacts.where(mine("artifact_id")), edges.where(mine("child_artifact_id")), valid.where(mine("artifact_id"))
    first = asked.where("_detail is null").groupBy("artifact_id").agg(F.min_by("_made", "request").alias("_first"), F.min("request").alias("_request"))
    stored = artifacts.select("artifact_id", said.alias("_stored"), F.col("auth_state").alias("_state"), (F.col("auth_tag") == node_tag(cfg)).alias("_signed")).join(ids, "artifact_id")
    sets = edges.select(F.col("child_artifact_id").alias("artifact_id"), authentic_edge(cfg).alias("_e")).join(ids, "artifact_id").groupBy("artifact_id").agg(F.count("*").alias("_n"), F.bool_and("_e").alias("_edges_ok"))
    held = valid.select("artifact_id", F.col("value").alias("_valid"))
    found = asked.join(first, "artifact_id", "left").join(stored, "artifact_id", "left").join(sets, "artifact_id", "left").join(held, "artifact_id", "left")
    kept = F.coalesce(F.col("_signed") & (F.col("_stored") == F.col("_made")), F.lit(False))
    whole = F.coalesce((F.col("_n") == F.col("parent_count")) & F.col("_edges_ok") & F.col("_valid"), F.lit(False))
    detail = (
        F.when(F.col("_detail").isNotNull(), F.col("_detail"))
        .when(F.col("_state") == "committed", F.when(~kept, "ARTIFACT_IMMUTABILITY_CONFLICT").when(~whole, "INVALID_COMMITTED_ANCESTRY").otherwise("WRITE_REPLAYED"))
        .when(F.col("_stored").isNotNull() & ~kept, "ARTIFACT_IMMUTABILITY_CONFLICT")
        .when(F.col("request") > F.col("_request"), F.when(F.col("_first") == F.col("_made"), "WRITE_REPLAYED").otherwise("ARTIFACT_IMMUTABILITY_CONFLICT"))
    )
    plan = rows.join(found.select("request", detail.alias("detail")), "request")
    return scratch.table(plan.select("request", "detail", *NODE_FIELDS, "parent_ids", "duplicate_parent_count"), "plan")


def pending(plan: DataFrame, artifacts: DataFrame, cfg: LineageConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(artifacts, edges) that a plan's open writes store first: records that are pending, and their edges."""
    rows = plan.where("detail is null").withColumn("auth_state", F.lit("pending"))
    nodes = rows.withColumn("auth_tag", node_tag(cfg)).select(*(F.col(f.name).cast(f.dataType) for f in ARTIFACTS))
    p = artifacts.select(F.col("artifact_id").alias("parent_artifact_id"), F.col("vertex_id").alias("parent_vertex_id"), F.col("generation").alias("parent_generation"))
    e = rows.select(
        F.explode("parent_ids").alias("parent_artifact_id"), F.col("artifact_id").alias("child_artifact_id"), F.col("vertex_id").alias("child_vertex_id"), F.col("lineage_kind").alias("kind"),
        F.col("generation").alias("child_generation"), "writer_id", "writer_key_id", "gate_id", "batch_id", "write_version",
    ).join(p, "parent_artifact_id").withColumn("edge_id", C.edge_id(F.col("child_artifact_id"), F.col("parent_artifact_id"), F.col("kind"), cfg))
    return nodes, e.withColumn("auth_tag", edge_tag(cfg)).select(*(F.col(f.name).cast(f.dataType) for f in EDGES))


def commit(plan: DataFrame, stored: DataFrame, edges: DataFrame, valid: DataFrame, cfg: LineageConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(``request``, ``artifact_id``, ``detail`` of every write; the artifacts as they are then).

    ``stored`` and ``edges`` are read back after :func:`pending` was written.  A
    record must be there as staged, and its edges authentic and exactly its
    parents; then it is committed, by a compare-and-set on batch, context,
    state and tag, and its parents, by ``valid``, must still be.
    """
    open_, scratch = plan.where("detail is null"), Scratch(plan.sparkSession, "commit")
    wanted, _ = pending(plan, stored, cfg)
    ids = scratch.table(open_.select("artifact_id").distinct(), "ids")
    mine, ids = _kinds_of(ids), few(ids)
    # records are compared by digests of all that is in them, and edges move without what their tags cover
    all_ = _digest([*NODE_FIELDS, "auth_tag"])
    back = stored.where(mine("artifact_id")).select("artifact_id", all_.alias("_back")).join(ids, "artifact_id").join(wanted.select("artifact_id", all_.alias("_want")), "artifact_id")
    edges = edges.where(mine("child_artifact_id")).select(F.col("child_artifact_id").alias("artifact_id"), "parent_artifact_id", "batch_id", authentic_edge(cfg).alias("_e")).join(ids, "artifact_id")
    sets = edges.groupBy("artifact_id").agg(F.count("*").alias("_n"), F.bool_and("_e").alias("_ok"), F.min("batch_id").alias("_b0"), F.max("batch_id").alias("_b1"))
    names = edges.select("artifact_id", "parent_artifact_id").join(sets.where(F.col("_n") <= MAX_PARENTS).select("artifact_id"), "artifact_id").groupBy("artifact_id").agg(F.array_sort(F.collect_list("parent_artifact_id")).alias("_parents"))
    each = open_.select("artifact_id", F.explode("parent_ids").alias("parent"))
    each = each.join(valid.where(_kinds_of(each.select("parent"))("artifact_id")).select(F.col("artifact_id").alias("parent"), F.col("value").alias("v")), "parent", "left")
    still = each.groupBy("artifact_id").agg(F.bool_and(F.coalesce("v", F.lit(False))).alias("_still"))
    rows = open_.select("request", "artifact_id", "parent_ids", "parent_count", "batch_id").join(back, "artifact_id", "left").join(sets, "artifact_id", "left").join(names, "artifact_id", "left").join(still, "artifact_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    exact = yes((F.col("_n") == F.col("parent_count")) & F.col("_ok") & (F.col("_parents") == F.col("parent_ids")) & (F.col("_b0") == F.col("batch_id")) & (F.col("_b1") == F.col("batch_id")))
    detail = F.when(~yes(F.col("_back") == F.col("_want")), "PENDING_STAGE_CONFLICT").when(~exact, "INCOMPLETE_STAGED_ANCESTRY").when(~yes(F.col("_still")), "COMMIT_VERIFICATION_FAILED").otherwise("WRITE_COMMITTED")
    done = scratch.table(rows.select("request", "artifact_id", detail.alias("detail")), "done")
    # what was staged whole is committed, and then found to be valid or not
    go = done.where(F.col("detail").isin("WRITE_COMMITTED", "COMMIT_VERIFICATION_FAILED")).select("artifact_id")
    new = open_.join(go, "artifact_id", "left_semi").withColumn("auth_tag", node_tag(cfg)).select("artifact_id", F.col("auth_tag").alias("committed_tag"), F.lit("committed").alias("committed"))
    expected = wanted.join(new, "artifact_id").select("artifact_id", "batch_id", "context_id", "auth_state", "auth_tag", "committed", "committed_tag")
    after = compare_and_set(stored, expected, "artifact_id", ("batch_id", "context_id", "auth_state", "auth_tag"), {"auth_state": "committed", "auth_tag": "committed_tag"})
    closed = plan.where("detail is not null").select("request", "artifact_id", "detail")
    return closed.unionByName(done), after


def probe(done: DataFrame, artifacts: DataFrame, edges: DataFrame, claimed: DataFrame) -> DataFrame:
    """What writes left behind: (``request``, ``detail``, ``child_vertices``, ``claimed_vertices``, ``child_edges``).

    ``claimed`` are (``request``, ``parent``): parents that a producer's output
    named, and that must not have come to be by that.
    """
    theirs = _kinds_of(done.select("artifact_id"), claimed.select("parent"))
    artifacts, edges = artifacts.where(theirs("artifact_id")), edges.where(theirs("child_artifact_id"))
    nodes = artifacts.groupBy("artifact_id").agg(F.count("*").alias("n"))
    out = done.join(claimed.select("request").distinct(), "request", "left_semi").join(nodes.withColumnRenamed("n", "child_vertices"), "artifact_id", "left")
    out = out.join(edges.groupBy(F.col("child_artifact_id").alias("artifact_id")).agg(F.count("*").alias("child_edges")), "artifact_id", "left")
    said = claimed.join(nodes.withColumnRenamed("artifact_id", "parent"), "parent", "left").groupBy("request").agg(F.sum(F.coalesce("n", F.lit(0))).alias("claimed_vertices"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.join(said, "request").select("request", "detail", none("child_vertices"), none("claimed_vertices"), none("child_edges"))


def tamper(df: DataFrame, where: Column, column: str, value) -> DataFrame:
    """A fixture: one column overwritten where a condition holds, tags left as they were."""
    return df.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column)))
