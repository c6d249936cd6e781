import json
import random

import pytest
from pyspark.sql import functions as F

from lineaspark.config import DEFAULT, LineageConfig
from lineaspark.functions import columns as C
from lineaspark.operators import closure, decide, ledger, lookups, paths, report, signing, writes
from lineaspark.plans.oracle import SMALL_E, SMALL_V
from lineaspark.schema import ARTIFACTS, EDGE_FIELDS, EDGES, NODE_FIELDS

from .reference_model import closure as plain_closure, id48, sha, tag

NODES = "artifact_id string, role string, generation int, lineage_kind string, content string, trust_state string, authority_id string"


def graph(spark, rng, n=60):
    """A random signed graph with diamonds and long chains: (artifacts, edges, parents)."""
    parents, gens = {}, {}
    for k in range(n):
        name = f"n/{k}"
        chosen = rng.sample(sorted(parents), min(len(parents), rng.randrange(0, 4))) if k > 4 else []
        parents[name] = sorted(chosen)
        gens[name] = max((gens[p] for p in chosen), default=-1) + 1
    rows = [(a, "claim" if p else "source", gens[a], "assert" if p else "source", f"content of {a} é\"\\", "derived" if p else "trusted_source", DEFAULT.writer_id if p else "registry") for a, p in parents.items()]
    pairs = [(a, p) for a, ps in parents.items() for p in ps]
    pairs += pairs[:10]
    return (*signing.sign(spark.createDataFrame(rows, NODES), spark.createDataFrame(pairs, "child string, parent string")), parents)


def test_tags_and_ids_match_hashlib(spark):
    artifacts, edges, parents = graph(spark, random.Random(1))
    assert artifacts.schema.fieldNames() == ARTIFACTS.fieldNames() and edges.schema.fieldNames() == EDGES.fieldNames()
    for r in artifacts.collect():
        a = r.artifact_id
        assert r.vertex_id == id48(f"lineage:vertex:{a}") and r.selector == sha(f"lineage:selector:{a}")
        assert r.parent_set_hash == sha(json.dumps(parents[a], separators=(",", ":")))
        assert r.auth_tag == tag(DEFAULT.signing_key, ["node-v3", *(r[f] for f in NODE_FIELDS)])
        assert r.content_hash == sha(f"content of {a} é\"\\")
    for r in edges.collect():
        assert r.edge_id == id48(f"lineage:edge:{r.child_artifact_id}:{r.parent_artifact_id}:assert")
        assert r.auth_tag == tag(DEFAULT.signing_key, ["edge-v2", *(r[f] for f in EDGE_FIELDS)])
    assert edges.count() == sum(map(len, parents.values()))


@pytest.mark.parametrize("key", [b"k" * 32, b"k" * 64, b"k" * 100])
def test_hmac_vectors(spark, key):
    import hashlib
    import hmac

    texts = ["", "a", "é😀", "x" * 1000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(C.hmac_sha256(key, F.col("t"))).collect()
    assert [r[0] for r in got] == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_closures_match_a_plain_model(spark):
    for seed, cap, nodes_cap, spoil in ((2, 16, 1000, 0), (3, 2, 1000, 0), (4, 16, 6, 3), (5, 3, 4, 2), (6, 3, 1000, 4)):
        rng = random.Random(seed)
        artifacts, edges, parents = graph(spark, rng)
        bad = set(rng.sample(sorted(parents), spoil))
        if bad:
            artifacts = writes.tamper(artifacts, F.col("artifact_id").isin(*bad), "authority_id", "someone")
        nodes, links = signing.checked(artifacts, edges)
        verdicts, reach = closure.walk(nodes.cache(), artifacts, cap, node_cap=nodes_cap)
        got, depths = verdicts.collect(), {}
        for r in reach.collect():
            depths.setdefault(r.root, {})[r.node] = r.depth
        assert len(got) == len(parents)
        for r in got:
            want = plain_closure(parents, lambda a: not parents[a], bad, r.artifact_id, cap, nodes_cap)
            assert r.classification == want[0], r
            if want[0] == "VERIFIED":
                assert (r.classification, r.node_count, r.edge_count, r.source_count, r.deepest_hops) == want
                assert len(depths[r.artifact_id]) == r.node_count and max(depths[r.artifact_id].values()) == r.deepest_hops
            else:
                assert r.node_count is None
        valid = {r.artifact_id: r.value for r in closure.valid_closures(nodes, links).collect()}
        for a in parents:
            assert valid[a] == (plain_closure(parents, lambda x: not parents[x], bad, a, 99)[0] == "VERIFIED")


def chain(spark, names, extra=()):
    """A signed chain of the names, the last a source, with more edges."""
    n = len(names)
    rows = [(a, "claim" if k < n - 1 else "source", n - 1 - k, "assert" if k < n - 1 else "source", a, "derived" if k < n - 1 else "trusted_source", "x") for k, a in enumerate(names)]
    pairs = [*zip(names, names[1:], strict=False), *extra]
    return signing.sign(spark.createDataFrame(rows, NODES), spark.createDataFrame(pairs, "child string, parent string"))


def test_a_fault_beyond_the_node_cap_is_not_reached(spark):
    artifacts, edges = chain(spark, ["r", "a", "b", "c", "s"], [("r", "c"), ("a", "s")])
    nodes, _ = signing.checked(writes.tamper(artifacts, F.col("artifact_id") == "s", "trust_state", "x"), edges)
    ask = lambda root, cap: closure.verify(nodes, artifacts.where(F.col("artifact_id") == root), 16, node_cap=cap).first()
    assert [ask("b", k).detail for k in (1, 2, 3)] == ["CLOSURE_NODE_CAP_REACHED", "EDGE_OR_PARENT", "EDGE_OR_PARENT"]
    assert ask("r", 2).classification == "UNRESOLVED" and ask("r", 3).classification == "INVALID" and ask("a", 1).classification == "INVALID"
    assert closure.verify(nodes, artifacts, 65).select("detail").distinct().collect()[0][0] == "INVALID_VERIFICATION_BOUNDS"


def test_repeats_do_not_count_towards_the_node_cap(spark):
    artifacts, edges = chain(spark, ["r", "a", "b", "s"], [("r", "b"), ("r", "s"), ("a", "s")])
    nodes, _ = signing.checked(artifacts, edges)
    row = closure.verify(nodes, artifacts.where("artifact_id = 'r'"), 16, node_cap=4).first()
    assert (row.detail, row.node_count, row.edge_count, row.deepest_hops) == ("ANCESTRY_VERIFIED", 4, 6, 3)


def test_nodes_without_an_allowed_generation_keep_a_row(spark):
    artifacts, edges = chain(spark, ["r", "a", "s"])
    odd = artifacts.withColumn("generation", F.when(F.col("artifact_id") == "a", F.lit(None).cast("int")).when(F.col("artifact_id") == "s", 1000).otherwise(F.col("generation")))
    nodes, links = signing.checked(odd, edges)
    assert {r.artifact_id: r.value for r in closure.valid_closures(nodes, links).collect()} == dict.fromkeys("ras", False)
    assert {r.artifact_id: r.value for r in closure.path_counts(nodes, links).collect()} == {"r": 0, "a": None, "s": None}


def test_a_walk_says_where_it_was_cut(spark):
    artifacts, edges = chain(spark, ["r", "a", "b", "s"])
    pairs = edges.select(F.col("child_artifact_id").alias("child"), F.col("parent_artifact_id").alias("parent"))
    from lineaspark.sources.snapshots import Scratch

    for depth, cut in ((2, {"r"}), (3, set()), (1, {"r", "a"})):
        rows = report.walk(pairs, artifacts, depth, Scratch(spark, "t")).collect()
        assert {r.root for r in rows if r.truncated} == cut
    heads, *_ = report.results(artifacts, edges, artifacts, LineageConfig(max_ancestry_depth=2))
    assert {r.root for r in heads.collect()} == {"a", "b", "s"}


def test_more_parents_than_are_allowed_are_never_gathered(spark):
    many = 70
    rows = [("c", "claim", 1, "assert", "c", "derived", "x"), *((f"s{k}", "source", 0, "source", "s", "trusted_source", "registry") for k in range(many))]
    artifacts, edges = signing.sign(spark.createDataFrame(rows, NODES), spark.createDataFrame([("c", f"s{k}") for k in range(many)], "child string, parent string"))
    row = signing.checked(artifacts, edges)[0].where("artifact_id = 'c'").first()
    assert row.parents is None and not row.structure_ok


def test_each_tampered_field_is_noticed(spark):
    artifacts, edges, parents = graph(spark, random.Random(7), 12)
    for f in (*NODE_FIELDS, "auth_tag"):
        value = {"long": 1, "integer": 40, "boolean": True}.get(ARTIFACTS[f].dataType.typeName(), "x")
        bad = artifacts.withColumn(f, F.when(F.col("artifact_id") == "n/11", F.lit(value).cast(ARTIFACTS[f].dataType)).otherwise(F.col(f)))
        got = bad.select((signing.authentic_node() & signing.identity_ok()).alias("ok"), F.col(f).eqNullSafe(F.lit(value)).alias("hit")).collect()
        if f != "terminal" or parents["n/11"]:
            assert sum(not r.ok for r in got) == 1, f
    for f in (*EDGE_FIELDS, "auth_tag"):
        value = {"long": 1, "integer": 40, "int": 40}.get(EDGES[f].dataType.typeName(), "x")
        got = edges.withColumn(f, F.lit(value).cast(EDGES[f].dataType)).select(signing.authentic_edge().alias("ok")).collect()
        assert not any(r.ok for r in got) or f == "write_version", f
    pending = artifacts.withColumn("auth_state", F.lit("pending"))
    assert not any(r[0] for r in pending.withColumn("auth_tag", signing.node_tag()).select(signing.authentic_node()).collect())
    nulls = artifacts.withColumn("batch_id", F.lit(None).cast("string")).select(signing.authentic_node())
    assert {r[0] for r in nulls.collect()} == {False}


def test_missing_parent_is_a_system_error_and_bad_ids_are_invalid(spark):
    artifacts, edges, parents = graph(spark, random.Random(8), 20)
    lost = next(p for ps in parents.values() for p in ps)
    nodes, links = signing.checked(artifacts.where(F.col("artifact_id") != lost), edges)
    asked = artifacts.select("artifact_id").unionByName(spark.createDataFrame([("absent",), ("",), ("x" * 257,), (None,)], "artifact_id string"))
    got = {r.artifact_id: (r.classification, r.detail) for r in closure.verify(nodes, asked, 16).collect()}
    for a, ps in parents.items():
        if lost in ps and a != lost:
            assert got[a][0] == "SYSTEM_ERROR"
    assert got[lost] == ("MISSING", "ARTIFACT_NOT_FOUND") and got["absent"][0] == "MISSING"
    assert got[""][0] == got["x" * 257][0] == got[None][0] == "INVALID"


def test_small_graph_paths(spark):
    e = spark.createDataFrame(SMALL_E, "child bigint, parent bigint, kind string")
    v = spark.createDataFrame(SMALL_V, "vertex bigint, key string, generation int, terminal boolean")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "node bigint")
    found = paths.search(e, ids(100, 200), ids(130, 220, 230), "incoming", 3).collect()
    assert len(found) == 4 and {k for r in found for k in r.kinds} == {"assert", "require", "summarize", "support"}
    assert paths.search(e, ids(300), ids(340), "incoming", 3).count() == 0
    out = paths.search(e, ids(340), None, "outgoing", 3)
    r = paths.unresolved(out, v.select(F.col("vertex").alias("node"), "terminal")).first()
    assert (r.source, r.frontier, r.hops) == (340, 310, 3)
    assert paths.search(e, ids(200), ids(230, 220), "incoming", 3, per_pair=1, limit=1).count() == 1
    loop = spark.createDataFrame([(1, 2, "a"), (2, 1, "a")], "child bigint, parent bigint, kind string")
    assert paths.search(loop, ids(1), None, "incoming", 5).count() == 1
    with pytest.raises(ValueError):
        paths.search(e, ids(1), None, "sideways")


BASE = {"action_id": "action-001", "subject_id": "subject-001", "action_type": "send_message", "parameters": {"data_class": "internal", "destination": "internal:alerts", "payload": "Approved action payload"}, "request_id": "request-001", "requested_at": 1000, "provenance_artifact_id": "action-argument-001"}


def test_intents(spark):
    p = BASE["parameters"]
    cases = [(BASE, "ACTION_INTENT_VALID")]
    cases += [(BASE | {f: 1}, "UNTRUSTED_CONTROL_FIELD") for f in ("trusted", "verified", "policy_result", "freshness", "role", "anything")]
    cases += [({k: v for k, v in BASE.items() if k != f}, "MISSING_ACTION_FIELD") for f in BASE]
    cases += [(BASE | {f: v}, "INVALID_ACTION_FIELD") for f, v in (("subject_id", ""), ("action_id", "a b"), ("action_id", "a\n"), ("action_type", "erase"), ("request_id", "x" * 257), ("requested_at", -1), ("requested_at", 2**53), ("requested_at", 1.5))]
    cases += [(BASE | {f: v}, "INVALID_ACTION_FIELD") for f, v in (("action_id", 7), ("subject_id", None), ("request_id", ["r"]), ("provenance_artifact_id", {"a": "b"}), ("action_type", True), ("requested_at", "5"), ("requested_at", None), ("requested_at", 1e300))]
    cases += [(BASE | {"parameters": p | {f: v}}, "INVALID_ACTION_PARAMETERS") for f in p for v in (7, None, [p[f]], {f: p[f]}, "x" * 9000)]
    cases += [(BASE | {"requested_at": v}, "ACTION_INTENT_VALID") for v in (1e3, 0, 5.0, 2**53 - 1)]
    cases += [(BASE | {"parameters": v}, "INVALID_ACTION_PARAMETERS") for v in (p | {"x": "y"}, p | {"data_class": "secret"}, p | {"payload": ""}, p | {"payload": "é" * 2049}, p | {"destination": "d" * 257}, p | {"payload": 7}, [], None, {"destination": "d"})]
    raw = [json.dumps(c, ensure_ascii=False) for c, _ in cases] + ["[1]", "no json", "null", None, json.dumps(BASE)[:-1] + ', "action_id": "b"}', '"text"']
    want = [d for _, d in cases] + ["INVALID_ACTION_INTENT"] * 6
    got = decide.validate_intents(spark.createDataFrame(list(enumerate(raw)), "n int, raw string")).orderBy("n").collect()
    assert [(r.n, r.detail) for r in got] == list(enumerate(want))
    semantic = json.dumps({"action_type": "send_message", "parameters": p, "subject_id": "subject-001"}, sort_keys=True, separators=(",", ":"))
    assert got[0].semantic_digest == sha(semantic)
    assert got[0].fingerprint == sha(json.dumps(BASE, sort_keys=True, separators=(",", ":")))
    assert all((r.semantic_digest is None) == (r.detail != "ACTION_INTENT_VALID") for r in got)
    assert sum(r.fingerprint == got[0].fingerprint for r in got) == 2  # 1000 and 1e3 are one number
    odd = BASE | {"parameters": p | {"payload": "\x0b \x1f \\u001F \\\x1a \x7f é \u2028"}}
    row = decide.validate_intents(spark.createDataFrame([(json.dumps(odd),)], "raw string")).first()
    assert row.fingerprint == sha(json.dumps(odd, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def test_parameters_of_other_actions_are_bounded(spark):
    from lineaspark.functions.bounded_json import canonical, number_text

    deep = {"a": 1}
    for _ in range(8):
        deep = {"a": deep}
    cfg = LineageConfig(action_types=("send_message", "other"))
    cases = [({"b": [1, 2.5, None], "a": {"x": True}}, True), ({}, True), (deep["a"], True), (deep, False), ({"a": [0] * 64}, True), ({"a": [0] * 65}, False), ({f"k{j}": 0 for j in range(33)}, False), ({"a b": 1}, False), ({"k" * 65: 1}, False), ({"a": "x" * 9000}, False), ([], False)]
    raw = [json.dumps(BASE | {"action_type": "other", "parameters": c}) for c, _ in cases]
    got = decide.validate_intents(spark.createDataFrame(list(enumerate(raw)), "n int, raw string"), cfg).orderBy("n").collect()
    assert [r.status == "PASS" for r in got] == [ok for _, ok in cases]
    assert got[0].semantic_digest == sha('{"action_type":"other","parameters":{"a":{"x":true},"b":[1,2.5,null]},"subject_id":"subject-001"}')
    assert canonical('{"p":{"z":-0.0,"b":1e21,"c":123456789012345680000,"d":1e-7,"e":0.000001,"f":-12.5}}', "p") == '{"b":1e+21,"c":123456789012345680000,"d":1e-7,"e":0.000001,"f":-12.5,"z":0}'
    for k in range(300):
        x = random.Random(k).uniform(-1, 1) * 10.0 ** random.Random(-k).randrange(-30, 30)
        assert float(number_text(x)) == x


def test_policy_order_and_freshness(spark):
    good = {"subject_id": "s", "state_subject_id": "s", "semantic_digest": "d", "state_digest": "d", "ancestry_status": "RESOLVED", "n_witnesses": 3, "n_sources": 2, "n_untrusted": 0, "n_unallowed": 0, "destination": "internal:alerts", "data_class": "internal"}
    steps = [("state_digest", "x", "ACTION_BINDING_MISMATCH"), ("ancestry_status", None, "UNRESOLVED_ANCESTRY"), ("n_witnesses", None, "MISSING_PROVENANCE_WITNESS"), ("n_sources", 1, "INSUFFICIENT_TRUSTED_SOURCES"), ("n_untrusted", 1, "UNTRUSTED_TERMINAL_SOURCE"), ("n_unallowed", 1, "SOURCE_AUTHORITY_NOT_ALLOWED"), ("destination", "internal:alerts-x", "DESTINATION_NOT_ALLOWED"), ("data_class", "restricted", "DATA_CLASS_NOT_ALLOWED")]
    schema = ", ".join(f"{k} {'bigint' if k[:2] == 'n_' else 'string'}" for k in good)
    for k in range(len(steps) + 1):  # all faults from k on: the first one counts
        row = good | {f: v for f, v, _ in steps[k:]}
        got = decide.policy(spark.createDataFrame([tuple(row.values())], schema), LineageConfig(min_trusted_sources=2)).first()
        assert got.policy_detail == (steps[k][2] if k < len(steps) else "POLICY_ALLOW")
        assert (got.policy_reason is None) == (k == len(steps))
    times = [(1000, 1000, None), (5999, 1000, None), (6000, 1000, "TRUSTED_STATE_EXPIRED"), (999, 1000, "TRUSTED_CLOCK_ROLLBACK"), (-1, 1000, "TRUSTED_CLOCK_INVALID"), (None, 1000, "TRUSTED_CLOCK_INVALID")]
    got = spark.createDataFrame(times, "now bigint, at bigint, want string").select("want", decide.freshness(F.col("now"), F.col("at")).alias("f")).collect()
    assert all(r.want == r.f for r in got)


def plain_ledger(rows, capacity=None, eligible=lambda e: True, adapter=lambda e: "ok", held=()):
    requests = {r: (fp, a, ad) for r, a, fp, ad in held}
    actions = {a: ad for _, a, _, ad in held}
    out = {}
    for event, _, request, action, fp in sorted(rows, key=lambda r: (r[1], r[0])):
        if request in requests:
            f, a, ad = requests[request]
            out[event] = "ACTION_INDETERMINATE" if ad != "ok" else "REQUEST_REPLAYED" if (f, a) == (fp, action) else "REQUEST_ID_CONFLICT"
        elif action in actions:
            out[event] = "ACTION_INDETERMINATE" if actions[action] != "ok" else "ACTION_ID_CONFLICT"
        elif capacity is not None and len(requests) >= capacity:
            out[event] = "ACTION_LEDGER_FULL"
        elif eligible(event):
            requests[request] = (fp, action, adapter(event))
            actions[action] = adapter(event)
            out[event] = "RESERVED"
        else:
            out[event] = "CLEAR"
    return out


REQUESTS = "event bigint, arrived_at bigint, request_id string, action_id string, fingerprint string"


def test_ledger_matches_a_sequential_fold(spark):
    rng = random.Random(12)
    rows = [(k, rng.randrange(50), f"r{rng.randrange(60)}", f"a{rng.randrange(60)}", rng.choice("fg")) for k in range(200)]
    df = spark.createDataFrame(rows, REQUESTS).repartition(5)
    for fold in (0, 10, 100_000):  # by rounds alone, by both, by one round and the fold
        got = ledger.settle(df, fold=fold).collect()
        assert {r.event: r.outcome for r in got} == plain_ledger(rows)
    for cap in (0, 7, 10_000):
        assert dict(map(tuple, ledger.replay(df, capacity=cap).collect())) == plain_ledger(rows, cap)
    eligible, adapter = (lambda e: e % 3 != 1), (lambda e: {0: "failed", 1: "timeout"}.get(e % 5, "ok"))
    held = [("r1", "a1", "f", "ok"), ("r2", "a2", "g", "timeout"), ("r3", "b", "f", "ok")]
    rich = df.withColumn("eligible", F.col("event") % 3 != 1).withColumn("adapter", F.when(F.col("event") % 5 == 0, "failed").when(F.col("event") % 5 == 1, "timeout"))
    for cap in (None, 12):
        got = ledger.settle(rich, cap, spark.createDataFrame(held, "request_id string, action_id string, fingerprint string, adapter string"))
        got = {r.event: (r.outcome, r.did) for r in got.withColumn("did", ledger.executed(got)).collect()}
        want = plain_ledger(rows, cap, eligible, adapter, held)
        assert {e: o for e, (o, _) in got.items()} == want
        assert all(d == ({"ok": "EXECUTED", "failed": "ACTION_ADAPTER_FAILED", "timeout": "ACTION_ADAPTER_TIMEOUT"}[adapter(e)] if o == "RESERVED" else None) for e, (o, d) in got.items())
        assert len(set(want.values())) >= 5
    single = [(k, t, f"u{k}", a, f) for k, t, _, a, f in rows]
    assert dict(map(tuple, ledger.first_wins(spark.createDataFrame(single, REQUESTS)).collect())) == plain_ledger(single)
    done = ledger.settle(spark.createDataFrame(single, REQUESTS))
    assert ledger.call_log(done, spark.createDataFrame(single, REQUESTS)).count() == sum(o == "RESERVED" for o in plain_ledger(single).values())
    assert ledger.settle(spark.createDataFrame([], REQUESTS), 5).collect() == []


def test_a_chain_of_ids_takes_rounds_or_the_fold(spark):
    rows = [(k, k, f"r{k // 2}", f"a{(k + 1) // 2}", "f") for k in range(24)]
    df = spark.createDataFrame(rows, REQUESTS)
    for fold in (0, 5):
        assert {r.event: r.outcome for r in ledger.settle(df, fold=fold).collect()} == plain_ledger(rows)


def test_writes(spark):
    artifacts, edges, parents = graph(spark, random.Random(15), 25)
    assert writes.upsert_edges(edges.limit(0), edges.unionByName(edges), artifacts).count() == edges.count()
    raw = ['{"content":"x"}', '{"content":"x","role":"source"}', "[]", '{"content":1}', "{}", json.dumps({"content": "y" * 1_000_001})]
    faults = [r[0] for r in spark.createDataFrame([(r,) for r in raw], "raw string").select(writes.producer_output(F.col("raw"))).collect()]
    assert faults[:4] == [None, "UNTRUSTED_CONTROL_FIELD", "INVALID_PRODUCER_OUTPUT", "INVALID_ARTIFACT_CONTENT"] and faults[4] == "INVALID_ARTIFACT_CONTENT" and faults[5] == "ARTIFACT_CONTENT_TOO_LARGE"
    nested = ['{"content":{"content":"x"}}', '{"content":"a","content":"b"}', '"content"', None, '{"content":""}']
    faults = [r[0] for r in spark.createDataFrame([(r,) for r in nested], "raw string").select(writes.producer_output(F.col("raw"))).collect()]
    assert faults == ["INVALID_ARTIFACT_CONTENT", "INVALID_PRODUCER_OUTPUT", "INVALID_PRODUCER_OUTPUT", "INVALID_PRODUCER_OUTPUT", None]
    asked = spark.createDataFrame([("c", "claim", "assert", "n/0"), ("c", "claim", "assert", "n/0"), ("d", "claim", "assert", "d"), ("e", "boss", "assert", "n/0"), ("f", "claim", "like", "n/0"), ("g", "claim", "assert", "gone")], "artifact_id string, role string, kind string, parent string")
    valid = artifacts.select("artifact_id", F.lit(True).alias("value"))
    more = [("h", "claim", "assert", "n/0"), ("h", "claim", "assert", ""), ("i", "claim", "assert", None)] + [("j", "claim", "assert", f"n/{k % 5}") for k in range(65)] + [("", "claim", "assert", "n/0")]
    other = {r.artifact_id: r.detail for r in writes.prepare(spark.createDataFrame(more, asked.schema), artifacts, valid).collect()}
    assert other == {"h": "INVALID_OBSERVED_PARENTS", "i": "INVALID_OBSERVED_PARENTS", "j": "INVALID_OBSERVED_PARENTS", "": "INVALID_ARTIFACT_ID"}
    first = writes.prepare(asked, artifacts, valid, LineageConfig(max_generation=1)).where("artifact_id = 'c'").first()
    assert first.detail == "CONTEXT_PREPARED" and writes.prepare(asked, artifacts.withColumn("generation", F.lit(1)), valid, LineageConfig(max_generation=1)).where("artifact_id = 'c'").first().detail == "GENERATION_CAP_EXCEEDED"
    assert writes.prepare(asked, artifacts.unionByName(artifacts), valid).where("artifact_id = 'c'").first().detail == "PARENT_RESOLUTION_FAILED"
    whole = writes.prepare(asked, artifacts, valid).where("detail = 'CONTEXT_PREPARED'").drop("detail")
    assert whole.select(writes.valid_context()).first()[0]
    for c in writes.CONTEXT:  # any change at all is noticed
        kind = whole.schema[c].dataType
        value = F.array(F.lit("x")) if kind.typeName() == "array" else F.lit(9).cast(kind) if kind.typeName() != "string" else F.lit("claim2")
        assert not whole.withColumn(c, value).select(writes.valid_context()).first()[0], c
        assert not whole.withColumn(c, F.lit(None).cast(kind)).select(writes.valid_context()).first()[0], c
    details = {r.artifact_id: (r.detail, r.duplicate_parent_count) for r in writes.prepare(asked, artifacts, valid).collect()}
    assert details == {"c": ("CONTEXT_PREPARED", 1), "d": ("SELF_PARENT", 0), "e": ("INVALID_DERIVED_ROLE", 0), "f": ("INVALID_EDGE_KIND", 0), "g": ("PARENT_NOT_AUTHENTIC", 0)}


def test_lookups_and_labels(spark):
    artifacts, edges, parents = graph(spark, random.Random(16), 15)
    one = artifacts.first()
    assert lookups.by_vertex(artifacts, one.vertex_id).collect() == [one]
    assert lookups.duplicate_keys(artifacts, "vertex_id").count() == 0
    with pytest.raises(Exception, match="repeated vertex"):
        lookups.by_vertex(artifacts.unionByName(artifacts), one.vertex_id).collect()
    assert lookups.mismatched(artifacts, writes.tamper(artifacts, F.col("artifact_id") == "n/3", "artifact_id", "m")).collect() == [("n/3", "m")]
    said = spark.createDataFrame([("pass",), ("Block_Policy",), ("NOT_REACHED",), (None,), ("ALLOW",), ("BLOCK",)], "s string")
    assert [tuple(r) for r in said.select(C.outcome_status(F.col("s")), C.status_kind(F.col("s")), C.status_label(F.col("s"))).collect()] == [("NOT_REACHED", "pass", "PASS"), ("NOT_REACHED", "block", "BLOCK POLICY"), ("NOT_REACHED", "neutral", "NOT REACHED"), ("NOT_REACHED", "neutral", "NOT RUN"), ("PASS", "pass", "ALLOW"), ("BLOCK", "block", "BLOCK")]
    rows = spark.createDataFrame([("c1", "a", "1"), ("c1", "a", "1"), ("c2", "b", "1")], "name string, x string, y string")
    want = spark.createDataFrame([("c1", "x", "a"), ("c2", "x", "b"), ("c2", "y", "2"), ("c2", "z", "1"), ("c3", "x", "a")], "name string, field string, value string")
    assert {(r.name, r.field): r.ok for r in decide.field_contract(rows, want).collect()} == {("c1", "x"): False, ("c2", "x"): True, ("c2", "y"): False, ("c2", "z"): False, ("c3", "x"): False}
    assert decide.element(rows, "c2").x == "b"
    for name in ("c1", "c3"):
        with pytest.raises(ValueError):
            decide.element(rows, name)
    heads, sources, witnesses = report.results(artifacts, edges, artifacts)
    mixed = sources.limit(1).select("root", *(F.col(c) for c in lookups.SUMMARY if c != "artifact_id"), F.explode(F.array(*map(F.lit, ("B", "a", "c", "é", "d")))).alias("artifact_id"))
    assert [x.artifact_id for x in report.listed(mixed, witnesses.limit(0)).first().sources] == ["a", "B", "c", "d", "é"]
    for r in report.listed(sources, witnesses).where("witnesses is not null").collect():
        assert [w.edge_id for w in r.witnesses] == sorted(w.edge_id for w in r.witnesses)
    assert lookups.expand(edges, artifacts.where("not terminal")).where("dangling").count() == sum(not parents[p] for ps in parents.values() for p in ps)
    row = spark.range(1).select(C.clock_text(F.lit(3661000)), C.clock_text(F.lit(-1)), C.media_type(F.lit(" Text/JSON ; q=1")), C.shortened(F.lit("abcdef"), 4), C.counted(F.lit(1), "path"), C.counted(F.lit(2), "path"), C.canonical_json(F.lit('{"b":1,"a":[true,null]}'))).first()
    assert tuple(row) == ("01:01:01", "unknown", "text/json", "abc…", "1 path", "2 paths", '{"a":[true,null],"b":1}')


def test_config_bounds():
    for bad in ({"signing_key": b"short"}, {"max_ancestry_depth": 65}, {"max_freshness_ms": 0}, {"max_closure_nodes": 100_001}):
        with pytest.raises(ValueError):
            LineageConfig(**bad)


def test_result_sets(spark):
    from lineaspark.sources import tables

    cells = [[{"type": "vertex_id", "value": 42}, {"type": "string", "value": "a"}, {"type": "boolean", "value": True}, {"type": "null"}], [{"type": "vertex_id", "value": 1}, {"type": "string", "value": "7"}, {"type": "null", "value": "x"}, {"type": "string", "value": ""}]]
    raw = lambda **k: spark.createDataFrame([(json.dumps({"columns": ["vertex_id", "artifact_id", "terminal", "authority_id"], "rows": cells} | k),)], "raw string")
    schema = "vertex_id bigint, artifact_id string, terminal boolean, authority_id string"
    assert sorted(map(tuple, tables.decode_results(raw(), schema).collect())) == [(1, "7", None, ""), (42, "a", True, None)]
    assert tables.decode_results(raw(rows=[]), schema).collect() == []
    for bad in ({"rows": [cells[0][:3]]}, {"columns": ["a"]}, {"rows": None}, {"columns": None}):
        with pytest.raises(Exception, match="unexpected result shape"):
            tables.decode_results(raw(**bad), schema).collect()
    path = {"nodes": [{"id": 1, "properties": {"key": "a"}}, {"id": 2, "properties": {}}], "relationships": [{"src": 2, "dst": 1, "edge_type": "D", "properties": {"kind": "assert"}}]}
    row = tables.decode_paths(raw(columns=["path"], rows=[[{"type": "path", "value": path}]])).first()
    assert [n.id for n in row.nodes] == [1, 2] and row.relationships[0].properties == {"kind": "assert"}
    for bad in ({"type": "node", "value": path}, {"type": "path", "value": path | {"nodes": path["nodes"][:1]}}):
        with pytest.raises(Exception, match="expected a path"):
            tables.decode_paths(raw(columns=["path"], rows=[[bad]])).collect()


def test_snapshot_round_trip(spark, tmp_path):
    from lineaspark.sources import tables

    artifacts, edges, _ = graph(spark, random.Random(17), 10)
    tables.save_graph(artifacts, edges, str(tmp_path / "g"))
    a, e = tables.load_graph(spark, str(tmp_path / "g"))
    assert sorted(a.collect()) == sorted(artifacts.collect()) and e.count() == edges.count()
    tables.write_report(edges.select("kind"), str(tmp_path / "r"))
    assert tables.read_report(spark, str(tmp_path / "r"), "kind string").count() == edges.count()
    assert tables.file_digests(spark, str(tmp_path / "r")).count() >= 1 and tables.ready(spark)
    assert tables.single_value(tables.query(spark, "select :x + 1", {"x": 1})) == 2
    with pytest.raises(ValueError):
        tables.single_value(spark.range(2))
