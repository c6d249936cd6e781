"""From a raw intent to a decision: validation, digests, policy, freshness and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DATA_CLASSES, DEFAULT, INTENT_FIELDS, MAX_IDENTIFIER_BYTES, MAX_PARAMETER_BYTES, MAX_PAYLOAD_BYTES, PARAMETER_FIELDS, SENDING, LineageConfig
from ..functions import columns as C, surrogates
from ..functions.bounded_json import bounded_json
from ..sources.snapshots import Scratch, passing


def validate_intents(raw: DataFrame, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """``raw`` (JSON text) with the intent's fields, ``status``, ``detail``, ``rejected_fields`` and digests.

    The first fault counts: object, unexpected fields, missing fields, scalar
    fields, parameters.  A field of another JSON type is null here and a fault.
    Digests are null unless the intent is valid.  Text that is no JSON object,
    repeats a field's name, or is null is an invalid intent.  Parameters of an
    action type other than ``send_message`` are any object within the limits of
    ``functions.bounded_json``.  Half of a surrogate pair is its own value in
    digests, and three bytes of U+FFFD in columns and for limits.
    """
    v = F.col("_v")
    scalars = tuple(f for f in INTENT_FIELDS if f not in ("parameters", "requested_at"))
    rows = raw.withColumn("_v", F.try_parse_json(surrogates.guarded(F.col("raw"))))
    rows = rows.select(
        "*", C.json_keys(v).alias("_keys"), *(C.json_text(v, f"$.{f}").alias(f) for f in scalars), C.json_integer(v, "$.requested_at").alias("requested_at"),
        F.when(C.is_object(v, "$.parameters"), surrogates.escaped(F.to_json(F.try_variant_get(v, "$.parameters", "variant")))).alias("parameters"),
        C.json_keys(v, "$.parameters").alias("_names"), *(C.json_text(v, f"$.parameters.{f}").alias(f) for f in PARAMETER_FIELDS),
    )
    listed = lambda names: F.array(*map(F.lit, names))
    rows = rows.withColumn("rejected_fields", F.array_sort(F.transform(F.array_except("_keys", listed(INTENT_FIELDS)), surrogates.shown)))
    fields = C.is_identifier(F.col("action_id")) & C.is_identifier(F.col("subject_id")) & C.is_identifier(F.col("request_id")) & C.is_identifier(F.col("provenance_artifact_id")) & F.coalesce(F.col("action_type").isin(*cfg.action_types), F.lit(False)) & F.col("requested_at").isNotNull()
    s = lambda f: C.json_string(F.col(f))
    inner = F.concat(F.lit('{"data_class":'), s("data_class"), F.lit(',"destination":'), s("destination"), F.lit(',"payload":'), s("payload"), F.lit("}"))
    shape = (F.array_sort("_names") == listed(PARAMETER_FIELDS)) & F.octet_length(surrogates.shown(F.col("destination"))).between(1, MAX_IDENTIFIER_BYTES) & F.col("data_class").isin(*DATA_CLASSES) & F.octet_length(surrogates.shown(F.col("payload"))).between(1, MAX_PAYLOAD_BYTES)
    if any(t != SENDING for t in cfg.action_types):
        sent = F.col("action_type") == SENDING
        inner, shape = F.when(sent, surrogates.escaped(inner)).otherwise(bounded_json(F.col("raw"), F.lit("parameters"))), F.when(sent, shape).otherwise(F.col("parameters").isNotNull())
    else:
        inner = surrogates.escaped(inner)
    rows = rows.withColumn("_inner", C.lower_escapes(inner))
    parameters = shape & (F.octet_length("_inner") <= MAX_PARAMETER_BYTES)
    detail = (
        F.when(F.col("_keys").isNull(), "INVALID_ACTION_INTENT").when(F.size("rejected_fields") > 0, "UNTRUSTED_CONTROL_FIELD")
        .when(F.size(F.array_except(listed(INTENT_FIELDS), "_keys")) > 0, "MISSING_ACTION_FIELD").when(~fields, "INVALID_ACTION_FIELD")
        .when(~F.coalesce(parameters, F.lit(False)), "INVALID_ACTION_PARAMETERS").otherwise("ACTION_INTENT_VALID")
    )
    # a value that isn't deterministic keeps later filters from being pushed down, each with a copy of all these expressions
    rows = rows.withColumn("detail", F.when(F.monotonically_increasing_id() >= 0, detail)).withColumn("status", F.when(F.col("detail") == "ACTION_INTENT_VALID", "PASS").otherwise("BLOCK"))
    semantic = F.concat(F.lit('{"action_type":'), s("action_type"), F.lit(',"parameters":'), F.col("_inner"), F.lit(',"subject_id":'), s("subject_id"), F.lit("}"))
    whole = F.concat(
        F.lit('{"action_id":'), s("action_id"), F.lit(',"action_type":'), s("action_type"), F.lit(',"parameters":'), F.col("_inner"), F.lit(',"provenance_artifact_id":'), s("provenance_artifact_id"),
        F.lit(',"request_id":'), s("request_id"), F.lit(',"requested_at":'), F.col("requested_at").cast("string"), F.lit(',"subject_id":'), s("subject_id"), F.lit("}"),
    )
    valid = F.col("status") == "PASS"
    return rows.withColumn("semantic_digest", F.when(valid, C.sha256_hex(semantic))).withColumn("fingerprint", F.when(valid, C.sha256_hex(whole))).withColumns({f: surrogates.shown(F.col(f)) for f in (*scalars, *PARAMETER_FIELDS)}).drop("_v", "_keys", "_names", "_inner")


def verification_block(classification: Column, detail: Column) -> Column:
    """struct(reason_code, detail) of an ancestry that isn't verified; null if it is."""
    pair = lambda r, d: F.struct(F.lit(r).alias("reason_code"), d.alias("detail"))
    return (
        F.when(classification == "VERIFIED", F.lit(None)).when(classification == "MISSING", pair("BLOCK_MISSING_PROVENANCE", F.lit("PROVENANCE_ARTIFACT_NOT_FOUND")))
        .when(classification == "UNRESOLVED", pair("BLOCK_UNRESOLVED_ANCESTRY", F.coalesce(detail, F.lit("UNRESOLVED_ANCESTRY"))))
        .when(classification == "SYSTEM_ERROR", pair("BLOCK_SYSTEM_ERROR", F.lit("PROVENANCE_VERIFICATION_FAILED"))).otherwise(pair("BLOCK_INVALID_PROVENANCE", F.coalesce(detail, F.lit("INVALID_PROVENANCE"))))
    )


def policy(rows: DataFrame, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """``rows`` with ``policy_reason`` and ``policy_detail`` (both of an allowing policy: null and POLICY_ALLOW); the first rule that fails counts.

    Takes per intent: ``subject_id``, ``state_subject_id``, ``semantic_digest``, ``state_digest``, ``ancestry_status``,
    ``n_witnesses``, ``n_sources``, ``n_untrusted``, ``n_unallowed`` (sources whose authority isn't on the list), ``destination``, ``data_class``.
    """
    bound = F.col("subject_id").eqNullSafe(F.col("state_subject_id")) & F.col("semantic_digest").eqNullSafe(F.col("state_digest"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    detail = (
        F.when(~bound, "ACTION_BINDING_MISMATCH").when(~F.col("ancestry_status").eqNullSafe(F.lit("RESOLVED")), "UNRESOLVED_ANCESTRY")
        .when((zero("n_witnesses") == 0) | (zero("n_sources") == 0), "MISSING_PROVENANCE_WITNESS").when(zero("n_sources") < cfg.min_trusted_sources, "INSUFFICIENT_TRUSTED_SOURCES")
        .when(zero("n_untrusted") > 0, "UNTRUSTED_TERMINAL_SOURCE").when(zero("n_unallowed") > 0, "SOURCE_AUTHORITY_NOT_ALLOWED")
        .when(~F.coalesce(F.col("destination").isin(*cfg.allowed_destinations), F.lit(False)), "DESTINATION_NOT_ALLOWED").when(F.col("data_class").eqNullSafe(F.lit("restricted")), "DATA_CLASS_NOT_ALLOWED").otherwise("POLICY_ALLOW")
    )
    d = F.col("policy_detail")
    reason = F.when(d == "ACTION_BINDING_MISMATCH", "BLOCK_INVALID_PROVENANCE").when(d == "UNRESOLVED_ANCESTRY", "BLOCK_UNRESOLVED_ANCESTRY").when(d == "MISSING_PROVENANCE_WITNESS", "BLOCK_MISSING_PROVENANCE").when(d != "POLICY_ALLOW", "BLOCK_POLICY")
    return rows.withColumn("policy_detail", detail).withColumn("policy_reason", reason)


def freshness(now: Column, verified_at: Column, cfg: LineageConfig = DEFAULT) -> Column:
    """Why a state can't be used at ``now``, or null; expiry counts before a clock that went back."""
    bad = ~(C.is_safe_integer(now) & C.is_safe_integer(verified_at))
    return F.when(bad, "TRUSTED_CLOCK_INVALID").when(now >= verified_at + cfg.max_freshness_ms, "TRUSTED_STATE_EXPIRED").when(now < verified_at, "TRUSTED_CLOCK_ROLLBACK")


def state_id(artifact_id: Column, batch_id: Column, digest: Column, verified_at: Column, cfg: LineageConfig = DEFAULT) -> Column:
    return C.sha256_hex(C.json_array(cfg.contract_version, ("s", artifact_id), ("s", batch_id), ("s", digest), ("n", verified_at)))


def source_sums(sources: DataFrame, witnesses: DataFrame, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """Per ``root`` of verification results: ``n_witnesses``, ``n_sources``, ``n_untrusted``, ``n_unallowed``."""
    s = sources.groupBy("root").agg(
        F.count("*").alias("n_sources"), F.count_if(~F.col("trust_state").eqNullSafe(F.lit("trusted_source"))).alias("n_untrusted"),
        F.count_if(~F.coalesce(F.col("authority_id").isin(*cfg.allowed_authorities), F.lit(False))).alias("n_unallowed"),
    )
    return s.join(witnesses.groupBy("root").agg(F.count("*").alias("n_witnesses")), "root", "full_outer")


def authorization_id(request_id: Column, action_id: Column, state: Column, cfg: LineageConfig = DEFAULT) -> Column:
    return C.sha256_hex(C.json_array(cfg.gateway_version, ("s", request_id), ("s", action_id), ("s", state)))


#: Reason codes of details, beside those that the verification and the policy give.
_REASONS = {
    "BLOCK_REPLAY": ("REQUEST_REPLAYED", "REQUEST_ID_CONFLICT", "ACTION_ID_CONFLICT"),
    "BLOCK_STALE": ("TRUSTED_STATE_EXPIRED",),
    "BLOCK_INVALID_PROVENANCE": ("MALFORMED_OR_UNBOUND_PROVENANCE",),
}


def authorize(requests: DataFrame, artifacts: DataFrame, edges: DataFrame, cfg: LineageConfig = DEFAULT, held: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """A decision for each of ``requests``, over one snapshot of signed ``artifacts`` and ``edges``.

    Requests are ``event_id``, ``arrived_at``, ``raw`` (the intent as JSON
    text), ``verified_at`` and ``now`` (what the trusted clock says when the
    state is issued and when it is used) and ``adapter`` (see ``ledger.settle``).
    ``held`` are reservations from before.  ``nodes`` are verdicts on the
    snapshot as ``signing.checked`` gives them, where they are stored; without
    them the ancestry that the requests can reach is verified, and no more.

    The checks in order: intent; replay and the ledger's capacity; ancestry, by
    verification, result contract and issuance of the trusted state; policy;
    freshness; and then the adapter.  A request that an earlier reservation
    bars is told so whatever its ancestry, and one that any check blocks
    reserves nothing.  Gives ``event_id``, ``arrived_at``, ``status``, ``reason_code``,
    ``detail``, ``stage`` (of ``CHECKS``, from 0; null if allowed), the intent's
    ids, ``content_hash``, ``trusted_state_id``, ``authorization_id``,
    ``policy_version``, ``n_sources``, ``n_witnesses`` and ``executed``.
    """
    from . import closure, ledger, report, signing

    scratch = Scratch(requests.sparkSession, "authorize")
    valid = scratch.table(validate_intents(requests, cfg).select("event_id", "arrived_at", "verified_at", "now", "adapter", F.col("status").alias("_valid"), F.col("detail").alias("_fault"), *_CARRIED), "intents")
    asked = valid.where("_valid = 'PASS'")
    roots = asked.select(F.col("provenance_artifact_id").alias("artifact_id")).distinct()
    with passing():
        inner = Scratch(requests.sparkSession, "ancestry-of-requests")
        if nodes is None:
            roots = inner.table(roots, "roots")
            nodes = inner.table(signing.checked(*signing.ancestry(artifacts, edges, roots, cfg.max_ancestry_depth, cfg), cfg)[0], "nodes")
        verdicts, reach = closure.walk(nodes, roots, cfg.max_ancestry_depth, cfg)
        verdicts = inner.table(verdicts, "verdicts")
        sound = verdicts.where("classification = 'VERIFIED'").select("artifact_id")
        heads, sources, witnesses = (inner.table(x, n) for x, n in zip(report.results(artifacts, edges, sound, cfg, reach), ("heads", "sources", "witnesses"), strict=True))
        whole = report.contract(heads.withColumn("digest", F.col("content_hash")), sources, witnesses, cfg, written=True)
        facts = verdicts.join(heads.select("root", "content_hash", "batch_id").withColumnRenamed("root", "artifact_id"), "artifact_id", "left")
        facts = facts.join(whole.select(F.col("root").alias("artifact_id"), F.col("valid").alias("_whole")), "artifact_id", "left").join(source_sums(sources, witnesses, cfg).withColumnRenamed("root", "artifact_id"), "artifact_id", "left")
        facts = scratch.table(facts.select("artifact_id", "classification", F.col("detail").alias("_found"), "content_hash", "batch_id", "_whole", "n_sources", "n_untrusted", "n_unallowed", "n_witnesses"), "facts")
    rows = asked.join(facts.withColumnRenamed("artifact_id", "provenance_artifact_id"), "provenance_artifact_id", "left")
    issued = C.is_safe_integer(F.col("verified_at")) & C.is_safe_integer(F.col("verified_at") + cfg.max_freshness_ms)
    state = F.when(issued & F.col("_whole"), state_id(F.col("provenance_artifact_id"), F.col("batch_id"), F.col("semantic_digest"), F.col("verified_at"), cfg))
    rows = policy(rows.withColumns({"trusted_state_id": state, "state_subject_id": F.col("subject_id"), "state_digest": F.col("content_hash"), "ancestry_status": F.lit("RESOLVED")}), cfg)
    block = verification_block(F.col("classification"), F.col("_found"))
    bound = F.coalesce(F.col("_whole") & (F.col("content_hash") == F.col("semantic_digest")), F.lit(False))
    old = F.when(~C.is_safe_integer(F.col("now")), "FRESHNESS_CHECK_FAILED").otherwise(freshness(F.col("now"), F.col("verified_at"), cfg))
    pair = lambda stage, reason, detail: F.struct(F.lit(stage).alias("stage"), reason.alias("reason_code"), detail.alias("detail"))
    own = (
        F.when(block.isNotNull(), pair(2, block["reason_code"], block["detail"])).when(~bound, pair(2, F.lit("BLOCK_INVALID_PROVENANCE"), F.lit("MALFORMED_OR_UNBOUND_PROVENANCE")))
        .when(~issued, pair(2, F.lit("BLOCK_SYSTEM_ERROR"), F.lit("TRUSTED_STATE_ISSUANCE_FAILED"))).when(F.col("policy_detail") != "POLICY_ALLOW", pair(3, F.col("policy_reason"), F.col("policy_detail")))
        .when(old.isNotNull(), pair(4, F.when(old == "TRUSTED_STATE_EXPIRED", "BLOCK_STALE").otherwise("BLOCK_SYSTEM_ERROR"), old))
    )
    rows = scratch.table(rows.withColumn("_own", own).drop("_valid", "_fault", "_found"), "checked")
    settled = ledger.settle(rows.select(F.col("event_id").alias("event"), "arrived_at", "request_id", "action_id", "fingerprint", F.col("_own").isNull().alias("eligible"), "adapter"), cfg.max_ledger_entries, held)
    settled = settled.select(F.col("event").alias("event_id"), "outcome", ledger.executed(settled).alias("_did"))
    out = valid.select("event_id", "arrived_at", "_valid", "_fault", *_CARRIED).join(rows.select("event_id", "_own", "content_hash", "trusted_state_id", "n_sources", "n_witnesses"), "event_id", "left").join(settled, "event_id", "left")
    early = F.col("outcome").isNotNull() & ~F.col("outcome").isin("RESERVED", "CLEAR")
    did = F.col("_did")
    detail = F.when(F.col("_valid") != "PASS", F.col("_fault")).when(early, F.col("outcome")).when(F.col("_own").isNotNull(), F.col("_own.detail")).when(did == "EXECUTED", "ACTION_EXECUTED").otherwise(did)
    coded = F.lit(None).cast("string")
    for code, details in _REASONS.items():
        coded = F.coalesce(coded, F.when(F.col("detail").isin(*details), code))
    reason = F.when(F.col("_valid") != "PASS", "BLOCK_INVALID_INPUT").when(F.col("detail") == "ACTION_EXECUTED", F.lit(None)).when(~early & F.col("_own").isNotNull(), F.col("_own.reason_code")).otherwise(F.coalesce(coded, F.lit("BLOCK_SYSTEM_ERROR")))
    stage = F.when(F.col("_valid") != "PASS", 0).when(early, 1).when(F.col("_own").isNotNull(), F.col("_own.stage")).when(did != "EXECUTED", 6)
    allowed = F.coalesce((did == "EXECUTED"), F.lit(False))
    reserved = F.coalesce(F.col("outcome") == "RESERVED", F.lit(False))
    return out.withColumn("detail", detail).select(
        "event_id", "arrived_at", F.when(allowed, "ALLOW").otherwise("BLOCK").alias("status"), reason.alias("reason_code"), "detail", stage.cast("bigint").alias("stage"), *_IDS, "content_hash",
        F.when(reserved, F.col("trusted_state_id")).alias("trusted_state_id"), F.when(reserved, authorization_id(F.col("request_id"), F.col("action_id"), F.col("trusted_state_id"), cfg)).alias("authorization_id"),
        F.when(reserved, F.lit(cfg.policy_version)).alias("policy_version"), "n_sources", "n_witnesses", allowed.alias("executed"),
    )


_IDS = ("request_id", "action_id", "subject_id", "provenance_artifact_id")
_CARRIED = (*_IDS, "destination", "data_class", "semantic_digest", "fingerprint")


#: The checks of a decision, in order.
CHECKS = ("intent", "replay", "ancestry", "policy", "freshness", "authorization", "execution")


def check_list(decisions: DataFrame, key: str) -> DataFrame:
    """(key, ``position``, ``check``, ``result``) from ``stage``, the position (from 0) of the check that blocked, or null: PASS before it, BLOCK at it, NOT_REACHED after."""
    rows = F.array(*(F.struct(F.lit(k).alias("position"), F.lit(c).alias("check")) for k, c in enumerate(CHECKS)))
    out = decisions.select(key, "stage", F.explode(rows).alias("c"))
    result = F.when(F.col("stage").isNull() | (F.col("c.position") < F.col("stage")), "PASS").when(F.col("c.position") == F.col("stage"), "BLOCK").otherwise("NOT_REACHED")
    return out.select(key, "c.position", "c.check", result.alias("result"))


def timeline(decisions: DataFrame) -> DataFrame:
    """(``event_id``, ``position``, ``label``, ``status``, ``detail``, ``at``) of what was reached, in order: the checks, then the outcome."""
    steps = [F.struct(F.lit(k).alias("position"), F.lit(f"Check {c}").alias("label"), F.when(F.col("stage") == k, "BLOCK").otherwise("PASS").alias("status")) for k, c in enumerate(CHECKS)]
    reached = F.slice(F.array(*steps), F.lit(1), F.coalesce(F.col("stage") + 1, F.lit(len(CHECKS))).cast("int"))
    last = F.struct(F.lit(len(CHECKS)).alias("position"), F.when(F.col("executed"), "Action executed").otherwise("Action blocked").alias("label"), C.outcome_status(F.col("status")).alias("status"))
    out = decisions.select("event_id", "detail", C.clock_text(F.col("arrived_at")).alias("at"), F.explode(F.concat(reached, F.array(last))).alias("s"))
    said = F.when((F.col("s.status") == "BLOCK") | (F.col("s.position") == len(CHECKS)), F.col("detail"))
    return out.select("event_id", F.col("s.position").cast("bigint").alias("position"), "s.label", "s.status", said.alias("detail"), "at")


def response_consistent(status: Column, stage: Column, executed: Column) -> Column:
    """An ALLOW has no failed check and was executed; a BLOCK has one and wasn't."""
    return F.coalesce(F.when(status == "ALLOW", stage.isNull() & executed).otherwise(stage.isNotNull() & ~executed), F.lit(False))


def answered(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """A row for each of ``requests`` (``event_id``): its decision, or where there is none, or it contradicts itself, a block that counts nothing."""
    ok = response_consistent(F.col("status"), F.col("stage"), F.col("executed"))
    got = decisions.where(ok).select("event_id", "status", "reason_code", "detail", "n_sources", "n_witnesses", "executed")
    rows = requests.select("event_id").join(got, "event_id", "left")
    return rows.fillna({"status": "BLOCK", "detail": "SYSTEM_ERROR", "n_sources": 0, "n_witnesses": 0}).withColumn("executed", F.coalesce("executed", F.lit(False)))


def contract(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(``name``, ``ok``) of named results against a table of expected ``result``, ``reason_code`` and ``detail``; absent or repeated names fail."""
    got = results.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("result", "reason_code", "detail")).alias("got"))
    return expected.join(got, "name", "left").select("name", F.coalesce((F.col("n") == 1) & F.struct("result", "reason_code", "detail").eqNullSafe(F.col("got")), F.lit(False)).alias("ok"))


def rollup(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def field_contract(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(``name``, ``field``, ``ok``): named results' fields against expected values, all as text; a name or field that is absent or repeated fails.

    ``results`` has ``name`` and a column for each field, ``expected`` has ``name``, ``field`` and ``value``.
    """
    fields = [c for c in results.columns if c != "name"]
    got = results.select("name", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("got")) for f in fields))).alias("x")).select("name", "x.*")
    got = got.groupBy("name", "field").agg(F.count("*").alias("n"), F.min("got").alias("got"))
    return expected.join(got, ["name", "field"], "left").select("name", "field", F.coalesce((F.col("n") == 1) & F.col("got").eqNullSafe(F.col("value")), F.lit(False)).alias("ok"))


def element(results: DataFrame, name: str):
    """The one row of a name; anything else is an error."""
    rows = results.where(F.col("name") == name).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one row named {name}, not {len(rows)}")
    return rows[0]
