"""SQL text that the catalogue's oracles share; DuckDB dialect, over the driver's tables."""

from __future__ import annotations

from ..config import DEFAULT
from ..schema import EDGE_FIELDS, NODE_FIELDS, json_parts

ART = """
art AS (
  SELECT 'region/' || r_regionkey AS artifact_id, 'source' AS role, 0 AS generation, 'source' AS lineage_kind, r_name AS content, 'trusted_source' AS trust_state, 'registry' AS authority_id FROM region
  UNION ALL SELECT 'part/' || p_partkey, 'source', 0, 'source', p_name, CASE WHEN p_size % 25 = 0 THEN 'untrusted_source' ELSE 'trusted_source' END, CASE WHEN p_size % 20 = 1 THEN 'vendor' ELSE 'registry' END FROM part
  UNION ALL SELECT 'nation/' || n_nationkey, 'claim', 1, 'assert', n_name, 'derived', 'lineage-writer-v1' FROM nation
  UNION ALL SELECT 'supplier/' || s_suppkey, 'summary', 2, 'summarize', s_name, 'derived', 'lineage-writer-v1' FROM supplier
  UNION ALL SELECT 'customer/' || c_custkey, 'summary', 2, 'summarize', c_name, 'derived', 'lineage-writer-v1' FROM customer
  UNION ALL SELECT 'order/' || o_orderkey, 'claim', 3, 'support', o_orderstatus || '|' || o_orderpriority, 'derived', 'lineage-writer-v1' FROM orders
  UNION ALL SELECT DISTINCT 'lineitem/' || l_orderkey || '-' || l_linenumber, 'action_argument', 4, 'require', l_orderkey || '-' || l_linenumber, 'derived', 'lineage-writer-v1' FROM lineitem
)"""
OBS = """
obs AS (
  SELECT 'nation/' || n_nationkey AS child, 'region/' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier
  UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer
  UNION ALL SELECT 'order/' || o_orderkey, 'customer/' || o_custkey FROM orders
  UNION ALL SELECT 'lineitem/' || l_orderkey || '-' || l_linenumber, unnest(['order/' || l_orderkey, 'part/' || l_partkey, 'supplier/' || l_suppkey]) FROM lineitem
), edg AS (SELECT DISTINCT child, parent FROM obs)"""
PS = """
ps AS (
  SELECT child, list_sort(list(DISTINCT parent)) AS parent_ids, count(*) - count(DISTINCT parent) AS dup FROM obs GROUP BY child
)"""


def hmac(key: bytes, text: str) -> str:
    key = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in key).hex() for p in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"


def jarr(*parts: tuple[str, str] | str) -> str:
    """SQL for the text of a JSON array: strings are literals, pairs are (kind, expression)."""
    made = []
    for p in parts:
        kind, x = ("s", f"'{p}'") if isinstance(p, str) else p
        made.append(f"CAST(to_json({x}) AS VARCHAR)" if kind in "sa" else f"CAST({x} AS VARCHAR)")
    return "'[' || " + " || ',' || ".join(made) + " || ']'"


def id48(text: str) -> str:
    return f"CAST('0x' || substr(sha256({text}), 1, 12) AS BIGINT)"


VERTEX = id48("'lineage:vertex:' || artifact_id")
_CONTEXT = jarr("context-v2", ("s", "artifact_id"), ("s", "selector"), ("s", "role"), ("n", "generation"), ("s", "lineage_kind"), ("n", "parent_count"), ("s", "parent_set_hash"), ("a", "parent_ids"), DEFAULT.writer_id, DEFAULT.writer_key_id, DEFAULT.gate_id, ("n", "1"), ("n", "dup"))
_SIGNATURE = hmac(DEFAULT.connector_key, jarr("connector-attestation-v1", ("s", "artifact_id"), ("s", "sha256(content)"), DEFAULT.connector_issuer, DEFAULT.connector_key_id))
TOKEN = hmac(DEFAULT.signing_key, "substr(context_text, 1, length(context_text) - 1) || ',\"' || context_id || '\",\"' || batch_id || '\"]'")


def signed(art: str, obs: str) -> str:
    return f"""{art}, {obs}, {PS},
s1 AS (
  SELECT art.*, sha256('lineage:selector:' || artifact_id) AS selector, sha256(content) AS content_hash, role = 'source' AS terminal,
    coalesce(CAST(len(parent_ids) AS INTEGER), 0) AS parent_count, coalesce(parent_ids, CAST([] AS VARCHAR[])) AS parent_ids, coalesce(dup, 0) AS dup,
    coalesce(sha256(CAST(to_json(parent_ids) AS VARCHAR)), sha256('[]')) AS parent_set_hash, {VERTEX} AS vertex_id,
    CASE WHEN role = 'source' THEN sha256({jarr(DEFAULT.connector_issuer, DEFAULT.connector_key_id, ("s", _SIGNATURE))}) END AS source_proof
  FROM art LEFT JOIN ps ON artifact_id = child
), s2 AS (
  SELECT *, {_CONTEXT} AS context_text, {jarr("trusted-source-context-v1", ("s", "artifact_id"), ("s", "selector"), ("s", "source_proof"))} AS source_text FROM s1
), s3 AS (
  SELECT *, sha256(CASE WHEN terminal THEN source_text ELSE context_text END) AS context_id FROM s2
), s4 AS (
  SELECT *, sha256('lineage:' || CASE WHEN terminal THEN 'source' ELSE 'derived' END || '-batch:' || context_id) AS batch_id FROM s3
), s5 AS (
  SELECT *, 'committed' AS auth_state, '{DEFAULT.writer_id}' AS writer_id, '{DEFAULT.writer_key_id}' AS writer_key_id, '{DEFAULT.gate_id}' AS gate_id, 1 AS write_version, '{DEFAULT.create_only}' AS create_only,
    coalesce(source_proof, sha256({TOKEN})) AS authority_proof_hash FROM s4
), artifacts AS (
  SELECT {", ".join(NODE_FIELDS)}, {hmac(DEFAULT.signing_key, jarr("node-v3", *json_parts(NODE_FIELDS)))} AS auth_tag FROM s5
), e1 AS (
  SELECT {id48("'lineage:edge:' || child || ':' || parent || ':' || c.lineage_kind")} AS edge_id, child AS child_artifact_id, parent AS parent_artifact_id, c.lineage_kind AS kind, c.generation AS child_generation, p.generation AS parent_generation,
    c.writer_id, c.writer_key_id, c.gate_id, c.batch_id, c.write_version, c.vertex_id AS child_vertex_id, p.vertex_id AS parent_vertex_id
  FROM edg JOIN s5 c ON child = c.artifact_id JOIN s5 p ON parent = p.artifact_id
), edges AS (
  SELECT *, {hmac(DEFAULT.signing_key, jarr("edge-v2", *json_parts(EDGE_FIELDS)))} AS auth_tag FROM e1
)"""


SIGNED = signed(ART, OBS)

#: Closure of every line item: distinct (root, node) with the longest depth.
WALK = f"""{ART}, {OBS},
walk AS (
  SELECT artifact_id AS root, artifact_id AS node, 0 AS depth FROM art WHERE role = 'action_argument'
  UNION SELECT root, parent, depth + 1 FROM walk JOIN edg ON node = child
), reach AS (SELECT root, node, max(depth) AS depth FROM walk GROUP BY root, node)"""

EVENTS = """
ev AS (
  SELECT event_id AS n, epoch_ns(ts) // 1000000 AS ms, user_id, event_type, json_extract_string(props, '$.k') AS k,
    CASE WHEN event_id % 29 = 9 THEN 'erase' ELSE 'send_message' END AS action_type,
    CASE WHEN event_id % 13 = 5 THEN 'restricted' WHEN event_id % 17 = 6 THEN 'secret' ELSE 'internal' END AS data_class,
    CASE WHEN event_id % 11 = 3 THEN 'external:mail' ELSE 'internal:alerts' END AS destination,
    CASE WHEN event_id % 19 = 7 THEN '' ELSE 'event ' || event_type END AS about, 'user-' || user_id AS subject_id
  FROM events
)"""


def intents(again: bool) -> str:
    more = "UNION ALL SELECT n * -2, ms + 1, false, * FROM ev WHERE n % 73 = 26 UNION ALL SELECT n * -2 - 1, ms + 1, true, * FROM ev WHERE n % 79 = 27" if again else ""
    return f"""
i0 AS (
  SELECT n AS event_id, ms AS arrived_at, false AS changed, * FROM ev {more}
), i1 AS (
  SELECT * EXCLUDE (about), n % 41 = 12 OR n % 113 = 37 OR n % 127 = 38 AND n % 31 <> 10 AS no_object, n % 37 = 11 AS extra,
    CASE WHEN n % 41 = 12 OR n % 113 = 37 OR n % 127 = 38 AND n % 31 <> 10 OR n % 83 = 30 THEN NULL WHEN n % 23 = 8 THEN 'not valid' ELSE 'a:' || user_id || ':' || event_type || ':' || k END AS action_id,
    CASE WHEN n % 101 = 33 THEN repeat('p', 4097) ELSE about || CASE WHEN changed THEN '!' ELSE '' END END AS payload, 'r-' || n AS request_id, ms AS requested_at, 'action/' || n AS provenance_artifact_id
  FROM i0
), i2 AS (
  SELECT *, CASE WHEN no_object THEN 'INVALID_ACTION_INTENT' WHEN extra THEN 'UNTRUSTED_CONTROL_FIELD' WHEN n % 31 = 10 THEN 'MISSING_ACTION_FIELD'
    WHEN n % 83 = 30 OR n % 109 = 36 OR n % 89 = 31 OR n % 107 = 35 OR action_id = 'not valid' OR action_type = 'erase' THEN 'INVALID_ACTION_FIELD'
    WHEN n % 97 = 32 OR n % 103 = 34 OR n % 101 = 33 OR data_class = 'secret' OR payload = '' THEN 'INVALID_ACTION_PARAMETERS' ELSE 'ACTION_INTENT_VALID' END AS detail
  FROM i1
), intents AS (
  SELECT *, CASE WHEN detail = 'ACTION_INTENT_VALID' THEN 'PASS' ELSE 'BLOCK' END AS status,
    sha256('{{"action_type":"' || action_type || '","parameters":{{"data_class":"' || data_class || '","destination":"' || destination || '","payload":"' || payload || '"}},"subject_id":"' || subject_id || '"}}') AS semantic_digest,
    sha256('{{"action_id":"' || action_id || '","action_type":"' || action_type || '","parameters":{{"data_class":"' || data_class || '","destination":"' || destination || '","payload":"' || payload || '"}},"provenance_artifact_id":"' || provenance_artifact_id || '","request_id":"' || request_id || '","requested_at":' || requested_at || ',"subject_id":"' || subject_id || '"}}') AS fingerprint
  FROM i2
)"""


INTENTS = f"{EVENTS}, {intents(False)}"

#: The star without its line items, and with events' actions.
ACTION_ART = f"""{EVENTS}, {ART.replace("art AS (", "star AS (", 1)}, art AS (
  SELECT * FROM star WHERE role <> 'action_argument'
  UNION ALL SELECT 'action/' || n, 'action_argument', 4, 'require', CASE WHEN n % 47 = 15 THEN 'other' ELSE '{{"action_type":"' || action_type || '","parameters":{{"data_class":"' || data_class || '","destination":"' || destination || '","payload":"' || about || '"}},"subject_id":"' || subject_id || '"}}' END,
    'derived', 'lineage-writer-v1' FROM ev WHERE n % 43 <> 14
)"""
ACTION_OBS = f"""{OBS.replace("obs AS (", "lines AS (", 1).replace(", edg AS (SELECT DISTINCT child, parent FROM obs)", "")}, keys AS (
  SELECT (SELECT max(c_custkey) + 1 FROM customer) AS customers, (SELECT max(p_partkey) + 1 FROM part) AS parts, (SELECT max(o_orderkey) + 1 FROM orders) AS orders_
), obs AS (
  SELECT * FROM lines WHERE child NOT LIKE 'lineitem/%'
  UNION ALL SELECT 'action/' || n, 'customer/' || n % customers FROM ev, keys WHERE n % 43 <> 14
  UNION ALL SELECT 'action/' || n, 'part/' || (n + j) % parts FROM ev, keys, range(6) t(j) WHERE n % 43 <> 14 AND n % 61 <> 18 AND (j = 0 OR n % 59 = 17)
  UNION ALL SELECT 'action/' || n, 'order/' || n % orders_ FROM ev, keys WHERE n % 43 <> 14 AND n % 53 = 16
), edg AS (SELECT DISTINCT child, parent FROM obs)"""

#: Decisions over the actions' graph, of which two nations were tampered with and some parts were lost: depth 3, 9 nodes, 2 sources, a fifth of the events' number of reservations.
DECISIONS = f"""WITH RECURSIVE {signed(ACTION_ART, ACTION_OBS)}, {intents(True)},
lost AS (SELECT 'part/' || p_partkey AS id FROM part WHERE p_partkey % 97 = 5),
wk AS (
  SELECT artifact_id AS root, artifact_id AS node, 0 AS depth FROM art WHERE role = 'action_argument'
  UNION SELECT root, parent, depth + 1 FROM wk JOIN edg ON node = child WHERE depth < 3 AND parent NOT IN (SELECT id FROM lost)
), st AS (
  SELECT root, node, depth, CASE WHEN node IN (SELECT child FROM edg WHERE parent IN (SELECT id FROM lost)) THEN 'SYSTEM_ERROR' WHEN node IN ('nation/2', 'nation/9') THEN 'IDENTITY_OR_AUTHENTICITY'
    WHEN depth >= 3 AND role <> 'source' THEN 'DEPTH_CAP_REACHED' WHEN node IN (SELECT child FROM edg WHERE parent IN ('nation/2', 'nation/9')) THEN 'EDGE_OR_PARENT' END AS step
  FROM wk JOIN art ON node = artifact_id
), faults AS (
  SELECT root, depth AS fault_depth, step FROM st WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY root ORDER BY depth, node) = 1
), met AS (
  SELECT root, d, count(*) AS n FROM (SELECT root, node, min(depth) AS least FROM wk GROUP BY root, node), range(4) t(d) WHERE least <= d GROUP BY root, d
), capped AS (SELECT root, min(d) AS cap_depth FROM met WHERE n > 9 GROUP BY root),
deg AS (SELECT child, count(*) AS out FROM edg GROUP BY child),
verdicts AS (
  SELECT a.artifact_id AS root, CASE WHEN cap_depth IS NOT NULL AND (fault_depth IS NULL OR cap_depth <= fault_depth) THEN 'CLOSURE_NODE_CAP_REACHED' WHEN step IS NOT NULL THEN step ELSE 'ANCESTRY_VERIFIED' END AS found, content_hash, batch_id
  FROM artifacts a LEFT JOIN faults f ON a.artifact_id = f.root LEFT JOIN capped c ON a.artifact_id = c.root WHERE a.role = 'action_argument'
), reach AS (SELECT root, node, max(depth) AS depth FROM wk GROUP BY root, node),
sums AS (
  SELECT root, count(*) FILTER (WHERE role = 'source') AS n_sources, CAST(sum(coalesce(out, 0)) AS BIGINT) AS n_witnesses, count(*) FILTER (WHERE trust_state = 'untrusted_source') AS n_untrusted,
    count(*) FILTER (WHERE role = 'source' AND authority_id <> 'registry') AS n_unallowed, count(*) AS node_count, max(depth) AS deepest_hops, string_agg(node, ',' ORDER BY node) FILTER (WHERE role = 'source') AS source_ids
  FROM reach JOIN art ON node = artifact_id LEFT JOIN deg ON node = child WHERE root IN (SELECT root FROM verdicts WHERE found = 'ANCESTRY_VERIFIED') GROUP BY root
), times AS (
  SELECT *, CASE WHEN n % 23 = 21 THEN NULL WHEN n % 23 = 19 THEN verified_at + 5000 WHEN n % 23 = 20 THEN verified_at - 1 ELSE verified_at + 7 END AS now,
    CASE WHEN n % 29 = 23 THEN 'failed' WHEN n % 31 = 24 THEN 'timeout' ELSE 'ok' END AS adapter
  FROM (SELECT *, CASE WHEN n % 67 = 22 THEN NULL ELSE arrived_at + 10 END AS verified_at FROM intents)
), own AS (
  SELECT t.*, v.found, content_hash, batch_id, n_sources, n_witnesses,
    CASE WHEN t.status = 'BLOCK' THEN t.detail WHEN found IS NULL THEN 'PROVENANCE_ARTIFACT_NOT_FOUND' WHEN found = 'SYSTEM_ERROR' THEN 'PROVENANCE_VERIFICATION_FAILED' WHEN found <> 'ANCESTRY_VERIFIED' THEN found
      WHEN content_hash <> semantic_digest THEN 'MALFORMED_OR_UNBOUND_PROVENANCE' WHEN verified_at IS NULL THEN 'TRUSTED_STATE_ISSUANCE_FAILED'
      WHEN n_sources < 2 THEN 'INSUFFICIENT_TRUSTED_SOURCES' WHEN n_untrusted > 0 THEN 'UNTRUSTED_TERMINAL_SOURCE' WHEN n_unallowed > 0 THEN 'SOURCE_AUTHORITY_NOT_ALLOWED' WHEN destination <> 'internal:alerts' THEN 'DESTINATION_NOT_ALLOWED'
      WHEN data_class = 'restricted' THEN 'DATA_CLASS_NOT_ALLOWED' WHEN now IS NULL THEN 'FRESHNESS_CHECK_FAILED' WHEN now >= verified_at + 5000 THEN 'TRUSTED_STATE_EXPIRED' WHEN now < verified_at THEN 'TRUSTED_CLOCK_ROLLBACK' END AS own
  FROM times t LEFT JOIN verdicts v ON provenance_artifact_id = v.root LEFT JOIN sums s ON provenance_artifact_id = s.root
), firsts AS (
  SELECT event_id, request_id, action_id, fingerprint, adapter, arrived_at FROM own WHERE own IS NULL QUALIFY row_number() OVER (PARTITION BY action_id ORDER BY arrived_at, event_id) = 1
), won AS (
  SELECT * FROM firsts QUALIFY row_number() OVER (ORDER BY arrived_at, event_id) <= (SELECT greatest(1, least(100000, count(*) // 5)) FROM events)
), ledger AS (
  SELECT o.*, w.event_id = o.event_id AS reserved, w.adapter AS first_adapter,
    CASE WHEN o.status = 'BLOCK' THEN NULL
      WHEN (w.arrived_at, w.event_id) < (o.arrived_at, o.event_id) THEN CASE WHEN w.adapter <> 'ok' THEN 'ACTION_INDETERMINATE' WHEN w.request_id = o.request_id AND w.fingerprint = o.fingerprint THEN 'REQUEST_REPLAYED' WHEN w.request_id = o.request_id THEN 'REQUEST_ID_CONFLICT' ELSE 'ACTION_ID_CONFLICT' END
      WHEN w.event_id = o.event_id THEN NULL
      WHEN (SELECT count(*) FROM won) = (SELECT greatest(1, least(100000, count(*) // 5)) FROM events) AND (o.arrived_at, o.event_id) > (SELECT max((arrived_at, event_id)) FROM won) THEN 'ACTION_LEDGER_FULL' END AS early
  FROM own o LEFT JOIN won w ON o.action_id = w.action_id
), decided AS (
  SELECT *, CASE WHEN status = 'BLOCK' THEN own WHEN early IS NOT NULL THEN early WHEN own IS NOT NULL THEN own WHEN adapter = 'ok' THEN 'ACTION_EXECUTED' WHEN adapter = 'timeout' THEN 'ACTION_ADAPTER_TIMEOUT' ELSE 'ACTION_ADAPTER_FAILED' END AS said,
    CASE WHEN status = 'BLOCK' THEN 0 WHEN early IS NOT NULL THEN 1 WHEN own IS NULL AND adapter = 'ok' THEN NULL WHEN own IS NULL THEN 6 WHEN own IN ('FRESHNESS_CHECK_FAILED', 'TRUSTED_STATE_EXPIRED', 'TRUSTED_CLOCK_ROLLBACK') THEN 4
      WHEN own IN ('INSUFFICIENT_TRUSTED_SOURCES', 'UNTRUSTED_TERMINAL_SOURCE', 'SOURCE_AUTHORITY_NOT_ALLOWED', 'DESTINATION_NOT_ALLOWED', 'DATA_CLASS_NOT_ALLOWED') THEN 3 ELSE 2 END AS at_stage,
    CASE WHEN reserved THEN sha256({jarr(DEFAULT.contract_version, ("s", "provenance_artifact_id"), ("s", "batch_id"), ("s", "semantic_digest"), ("n", "verified_at"))}) END AS state_id
  FROM ledger
), decisions AS (
  SELECT event_id, CASE WHEN said = 'ACTION_EXECUTED' THEN 'ALLOW' ELSE 'BLOCK' END AS status,
    CASE WHEN said = 'ACTION_EXECUTED' THEN NULL WHEN at_stage = 0 THEN 'BLOCK_INVALID_INPUT' WHEN said IN ('REQUEST_REPLAYED', 'REQUEST_ID_CONFLICT', 'ACTION_ID_CONFLICT') THEN 'BLOCK_REPLAY' WHEN said = 'PROVENANCE_ARTIFACT_NOT_FOUND' THEN 'BLOCK_MISSING_PROVENANCE'
      WHEN said IN ('DEPTH_CAP_REACHED', 'CLOSURE_NODE_CAP_REACHED') THEN 'BLOCK_UNRESOLVED_ANCESTRY' WHEN said IN ('IDENTITY_OR_AUTHENTICITY', 'EDGE_OR_PARENT', 'MALFORMED_OR_UNBOUND_PROVENANCE') THEN 'BLOCK_INVALID_PROVENANCE'
      WHEN at_stage = 3 THEN 'BLOCK_POLICY' WHEN said = 'TRUSTED_STATE_EXPIRED' THEN 'BLOCK_STALE' ELSE 'BLOCK_SYSTEM_ERROR' END AS reason_code,
    said AS detail, CAST(at_stage AS BIGINT) AS stage, action_id, request_id, provenance_artifact_id, state_id AS trusted_state_id,
    CASE WHEN reserved THEN sha256({jarr(DEFAULT.gateway_version, ("s", "request_id"), ("s", "action_id"), ("s", "state_id"))}) END AS authorization_id, CASE WHEN reserved THEN '{DEFAULT.policy_version}' END AS policy_version,
    CASE WHEN at_stage IS NULL OR at_stage > 0 THEN n_sources END AS n_sources, CASE WHEN at_stage IS NULL OR at_stage > 0 THEN n_witnesses END AS n_witnesses, said = 'ACTION_EXECUTED' AS executed, adapter, coalesce(reserved, false) AS reserved, n
  FROM decided
)"""

#: The small viability graph, fixed values: vertices and edges.
SMALL_V = (
    (100, "source:external", 0, True), (110, "summary:external:1", 1, False), (120, "summary:external:2", 2, False), (130, "action:poisoned", 3, False), (200, "source:catalog", 0, True), (210, "claim:catalog", 1, False),
    (220, "action:safe", 2, False), (230, "action:mixed", 3, False), (300, "source:deep", 0, True), (310, "deep:1", 1, False), (320, "deep:2", 2, False), (330, "deep:3", 3, False), (340, "action:deep", 4, False),
)
SMALL_E = (
    (110, 100, "summarize"), (120, 110, "summarize"), (130, 120, "require"), (210, 200, "assert"), (220, 210, "require"), (230, 120, "require"),
    (230, 210, "support"), (310, 300, "assert"), (320, 310, "summarize"), (330, 320, "summarize"), (340, 330, "require"),
)
SMALL = "v(vertex, key, generation, terminal) AS (VALUES " + ", ".join(f"({a}, '{b}', {c}, {d})" for a, b, c, d in SMALL_V) + "), e(child, parent, kind) AS (VALUES " + ", ".join(f"({a}, {b}, '{c}')" for a, b, c in SMALL_E) + ")"


#: The small graph by keys, and every conversation's turns as a chain from its first to its last.
CHAINS = f"""{SMALL}, cv AS (SELECT DISTINCT conv_id, turn, min(turn) OVER w AS first, max(turn) OVER w AS last FROM conversations WINDOW w AS (PARTITION BY conv_id)
), g AS (
  SELECT a.key AS child, b.key AS parent, kind FROM e JOIN v a ON child = a.vertex JOIN v b ON parent = b.vertex
  UNION ALL SELECT 'turn/' || conv_id || '-' || turn, 'turn/' || conv_id || '-' || (turn - 1), 'support' FROM cv WHERE turn > first
), firsts AS (SELECT DISTINCT 'turn/' || conv_id || '-' || first AS node FROM cv), lasts AS (SELECT DISTINCT 'turn/' || conv_id || '-' || last AS node FROM cv)"""


def chain_paths(sources: str, targets: str | None, outgoing: bool, most: int) -> str:
    """Paths over ``CHAINS``; ``sources`` and ``targets`` are statements that give nodes."""
    here, there = ("child", "parent") if outgoing else ("parent", "child")
    end = f"AND here IN ({targets})" if targets else ""
    return f"""WITH RECURSIVE {CHAINS}, p AS (
  SELECT node AS source, node AS here, node AS nodes, '' AS kinds, 0 AS hops FROM ({sources}) t(node)
  UNION ALL SELECT source, {there}, nodes || '>' || {there}, CASE WHEN hops = 0 THEN kind ELSE kinds || '>' || kind END, hops + 1 FROM p JOIN g ON here = {here} WHERE hops < {most}
), found AS (SELECT source, here AS target, CAST(hops AS BIGINT) AS hops, nodes, kinds FROM p WHERE hops > 0 {end})"""


def capped(bad: str, most: int) -> str:
    """CTEs over ``walk``: ``faults`` (the least depth of a node with an edge to a bad one) and ``caps`` (the least depth by which more than ``most`` nodes are met), a root each."""
    return f"""faults AS (SELECT root, min(depth) AS fault_depth FROM walk WHERE node IN (SELECT child FROM edg WHERE parent IN {bad}) GROUP BY root),
met AS (SELECT root, d, count(*) AS n FROM (SELECT root, node, min(depth) AS least FROM walk GROUP BY root, node), range(5) t(d) WHERE least <= d GROUP BY root, d),
caps AS (SELECT root, min(d) AS cap_depth FROM met WHERE n > {most} GROUP BY root)"""
