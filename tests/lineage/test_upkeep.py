import json
import random

import pytest
from pyspark.sql import functions as F

from lineaspark.config import DEFAULT
from lineaspark.operators import closure, decide, signing, writes
from lineaspark.schema import ARTIFACTS, EDGES
from lineaspark.sources.snapshots import Scratch
from lineaspark.sources.versions import StaleVersion, Versions

from .test_lineage import graph


def rows(df, *columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


NODE = ("artifact_id", "node_ok", "structure_ok", "edges_ok", "dangling", "parents")
LINK = ("child", "parent", "edge_ok", "parent_missing", "child_generation", "parent_generation")


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_are_kept_up_as_a_full_run_makes_them(spark, seed):
    rng = random.Random(seed)
    scratch = Scratch(spark, "upkeep")
    artifacts, edges, parents = graph(spark, rng, 40)
    artifacts, edges = scratch.table(artifacts, "artifacts"), scratch.table(edges, "edges")
    names = sorted(parents)
    late = set(rng.sample(names, 10))  # arrive in a batch, with their edges; some had children that waited for them
    old, old_edges = artifacts.where(~F.col("artifact_id").isin(*late)), edges.where(~F.col("child_artifact_id").isin(*late))
    nodes, links = (scratch.table(x, f"old-{k}") for k, x in enumerate(signing.checked(old, old_edges)))
    valid = scratch.table(closure.valid_closures(nodes, links), "valid")
    spoilt, gone, unlinked = rng.sample(sorted(set(names) - late), 3)
    new = writes.tamper(artifacts, F.col("artifact_id") == spoilt, "content_hash", "0" * 64).where(F.col("artifact_id") != gone)
    new_edges = edges.where(F.col("child_artifact_id") != unlinked)
    changed = spark.createDataFrame([(x,) for x in [*late, spoilt, gone, unlinked, "absent"]], "artifact_id string")
    got = signing.rechecked(nodes, links, new, new_edges, changed)
    got = [scratch.table(x, f"got-{k}") for k, x in enumerate(got)]
    want = signing.checked(new, new_edges)
    assert rows(got[0], *NODE) == rows(want[0], *NODE) and rows(got[1], *LINK) == rows(want[1], *LINK)
    values = rows(closure.revalidated(valid, *got), "artifact_id", "value")
    assert values == rows(closure.valid_closures(*want), "artifact_id", "value")
    assert values != rows(valid, "artifact_id", "value")


def test_a_small_change_is_little_work(spark, monkeypatch):
    """One altered leaf of 300: what is verified anew is that leaf and its parents."""
    raw = [(f"s{k}", "source", 0, "source", "c", "trusted_source", "registry") for k in range(3)] + [(f"n{k}", "claim", 1, "assert", "c", "derived", DEFAULT.writer_id) for k in range(300)]
    pairs = [(f"n{k}", f"s{k % 3}") for k in range(300)]
    names = "artifact_id string, role string, generation int, lineage_kind string, content string, trust_state string, authority_id string"
    artifacts, edges = signing.sign(spark.createDataFrame(raw, names), spark.createDataFrame(pairs, "child string, parent string"))
    nodes, links = signing.checked(artifacts, edges)
    sizes, whole = [], signing.checked
    monkeypatch.setattr(signing, "checked", lambda a, e, cfg=DEFAULT: sizes.append((a.count(), e.count())) or whole(a, e, cfg))
    anew = signing.rechecked(nodes, links, writes.tamper(artifacts, F.col("artifact_id") == "n7", "content_hash", "0" * 64), edges, spark.createDataFrame([("n7",)], "artifact_id string"))
    assert sizes == [(2, 1)] and [r.artifact_id for r in anew[2].collect()] == ["n7"]
    assert anew[0].where("not node_ok").count() == 1 and anew[0].count() == 303


@pytest.mark.parametrize("depth", [0, 2, 16])
def test_the_ancestry_alone_gives_the_same_verdicts(spark, depth):
    rng = random.Random(depth)
    artifacts, edges, parents = graph(spark, rng, 50)
    names = sorted(parents)
    artifacts = writes.tamper(artifacts, F.col("artifact_id").isin(*rng.sample(names, 2)), "content_hash", "0" * 64).where(~F.col("artifact_id").isin(rng.choice(names)))
    asked = spark.createDataFrame([(x,) for x in [*rng.sample(names, 12), "absent", "", None]], "artifact_id string")
    whole, _ = signing.checked(artifacts, edges)
    part, _ = signing.checked(*signing.ancestry(artifacts, edges, asked, depth))
    assert part.count() <= whole.count()
    columns = closure.verify(whole, asked, depth).columns
    assert rows(closure.verify(part, asked, depth), *columns) == rows(closure.verify(whole, asked, depth), *columns)


def source(k, request, content, sign=True, **more):
    a = f"doc/{k}"
    return (request, json.dumps({"id": a, "content": content, "attestation": {"issuer": "registry", "key_id": DEFAULT.connector_key_id, "signature": f"{a}|{content}" if sign else "0" * 64}} | more))


def parsed(spark, rows):
    """The signature's place holds id and content, which the connector signs here."""
    p = writes.parse_sources(spark.createDataFrame(rows, "request bigint, raw string"))
    return p.withColumn("signature", F.when(F.col("signature").contains("|"), signing.attestation(F.col("artifact_id"), F.col("content"))).otherwise(F.col("signature")))


def test_registrations_are_written_and_read_back(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/store")
    store.commit({"artifacts": spark.createDataFrame([], ARTIFACTS), "edges": spark.createDataFrame([], EDGES)})
    details = lambda df: {r.request: r.detail for r in df.collect()}
    first = [source(1, 1, "x"), source(1, 2, "y"), source(1, 3, "x"), source(2, 4, "z", sign=False), source(2, 5, "z"), source(3, 6, "w", extra=1)]
    assert details(writes.register(parsed(spark, first), store)) == {
        1: "WRITE_COMMITTED", 2: "ARTIFACT_IMMUTABILITY_CONFLICT", 3: "WRITE_REPLAYED", 4: "SOURCE_ATTESTATION_INVALID", 5: "WRITE_COMMITTED", 6: "UNTRUSTED_CONTROL_FIELD"}
    again = [source(1, 1, "x"), source(2, 2, "other"), source(4, 3, "new")]
    assert details(writes.register(parsed(spark, again), store)) == {1: "WRITE_REPLAYED", 2: "ARTIFACT_IMMUTABILITY_CONFLICT", 3: "WRITE_COMMITTED"}
    assert store.list() == [1, 2, 3] and [store.read("artifacts", ARTIFACTS, v).count() for v in (1, 2, 3)] == [0, 2, 3]
    stored = store.read("artifacts", ARTIFACTS)
    nodes, _ = signing.checked(stored, store.read("edges", EDGES))
    assert nodes.where("node_ok and structure_ok").count() == 3
    with pytest.raises(StaleVersion):
        store.commit({"artifacts": stored.limit(0)}, base=2)


def test_records_of_another_kind_are_conflicts(spark):
    asked = parsed(spark, [source(k, k, "x") for k in range(4)])
    records = writes.registrations(asked).select(*(f.name for f in ARTIFACTS))
    claim = records.where("artifact_id = 'doc/1'").withColumn("role", F.lit("claim")).withColumn("auth_tag", signing.node_tag())
    other = writes.tamper(records, F.col("artifact_id") == "doc/2", "auth_tag", "0" * 64).where("artifact_id in ('doc/0', 'doc/2')")
    got = writes.register_sources(asked, claim.unionByName(other)).collect()
    assert {r.artifact_id: r.detail for r in got} == {"doc/0": "WRITE_REPLAYED", "doc/1": "ARTIFACT_IMMUTABILITY_CONFLICT", "doc/2": "ARTIFACT_IMMUTABILITY_CONFLICT", "doc/3": "WRITE_COMMITTED"}


def test_a_source_record_is_what_signing_makes(spark):
    asked = parsed(spark, [source(1, 1, "é x")])
    made = writes.registrations(asked).select(*(f.name for f in ARTIFACTS)).collect()
    raw = spark.createDataFrame([("doc/1", "source", 0, "source", "é x", "trusted_source", "registry")], "artifact_id string, role string, generation int, lineage_kind string, content string, trust_state string, authority_id string")
    assert made == signing.sign(raw, spark.createDataFrame([], "child string, parent string"))[0].collect()


def test_decisions_verify_what_requests_reach(spark, monkeypatch):
    from lineaspark.plans import catalogue
    from lineaspark.sources import star

    sf = "/root/testdata/sf0.001"
    requests = star.intents(spark, sf).withColumn("verified_at", F.col("arrived_at")).withColumn("now", F.col("arrived_at")).withColumn("adapter", F.lit("ok")).where("n % 50 = 0")
    artifacts, edges = catalogue.acting(spark, sf)
    seen = []
    whole = signing.checked
    monkeypatch.setattr(signing, "checked", lambda a, e, cfg=DEFAULT: seen.append(a.count()) or whole(a, e, cfg))
    alone = rows(decide.authorize(requests, artifacts, edges), "event_id", "detail", "trusted_state_id")
    assert seen[0] < artifacts.count() / 5
    assert alone == rows(decide.authorize(requests, artifacts, edges, nodes=whole(artifacts, edges)[0]), "event_id", "detail", "trusted_state_id")


def test_two_artifacts_of_one_vertex_id_have_verdicts_of_their_own(spark):
    """The digests of these two ids begin with the same 48 bits."""
    from lineaspark.functions import columns as C

    one, two = "order/11020535", "order/14506671"
    assert spark.range(1).select(C.vertex_id(F.lit(one)) == C.vertex_id(F.lit(two))).first()[0]
    nodes = [(x, "source", 0, "source", x, "trusted_source", "registry") for x in ("a", "b")] + [(x, "claim", 1, "support", x, "derived", "lineage-writer-v1") for x in (one, two)] + [("c", "claim", 2, "support", "c", "derived", "lineage-writer-v1")]
    nodes = spark.createDataFrame(nodes, "artifact_id string, role string, generation int, lineage_kind string, content string, trust_state string, authority_id string")
    pairs = spark.createDataFrame([(one, "a"), (two, "a"), (two, "b"), ("c", one)], "child string, parent string")
    verdicts, links = signing.checked(*signing.sign(nodes, pairs))
    assert all(r.structure_ok and r.edges_ok and not r.dangling for r in verdicts.collect())
    assert sorted((r.child, r.parent) for r in links.where("edge_ok").collect()) == sorted([(one, "a"), (two, "a"), (two, "b"), ("c", one)])
