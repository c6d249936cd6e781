"""How much is written and exchanged, by files and plans: what a larger input multiplies."""

import os
from pathlib import Path

import pytest
from lineaspark.config import LineageConfig
from lineaspark.functions import json_paths
from lineaspark.operators import closure, lookups, paths, report, signing, writes
from lineaspark.plans import catalogue
from lineaspark.sources import snapshots, star
from lineaspark.sources.snapshots import Scratch, passing, shared_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_a_snapshot_has_no_digests(spark):
    artifacts, edges = catalogue.signed(spark, SF)
    parts = catalogue.snapshots(spark, SF, "star").manifest()["tables"]
    size = sum(n for t in parts.values() for p in t for _, n in p["files"])
    assert size < 64 * artifacts.count()  # one digest of text a node would be more
    assert edges.where("auth_tag is null").isEmpty()


def test_parents_are_gathered_by_one_exchange(no_broadcast):
    rows = no_broadcast.createDataFrame([("c", "p"), ("c", "p"), ("c", "o"), *(("many", f"p{k}") for k in range(65))], "child string, parent string")
    sets = signing.parent_sets(rows)
    assert exchanges(sets) == 1
    got = {r.child: (r.parent_ids, r.parent_count, r.duplicate_parent_count) for r in sets.collect()}
    assert got == {"c": (["o", "p"], 2, 1), "many": (None, 65, 0)}


def test_edges_are_exchanged_once_for_each_end(no_broadcast):
    rows = no_broadcast.createDataFrame([("c", "p"), ("c", "p"), ("c", "o")], "child string, parent string")
    seen = lookups.resolve(rows, no_broadcast.createDataFrame([("p",)], "artifact_id string"))
    assert exchanges(seen) <= 3 and [tuple(r) for r in seen.collect()] == [("c", ["o"], 1)]
    nodes = no_broadcast.createDataFrame([("p", 1), ("o", 0)], "artifact_id string, generation int")
    asked = rows.selectExpr("child artifact_id", "'claim' role", "'support' kind", "parent")
    ready = writes.prepare(asked, nodes, nodes.selectExpr("artifact_id", "true value"))
    assert exchanges(ready) <= 4
    (r,) = ready.collect()
    assert (r.detail, r.generation, r.parent_ids, r.duplicate_parent_count) == ("CONTEXT_PREPARED", 2, ["o", "p"], 1)


def test_a_limit_ends_the_search_at_its_length(spark, monkeypatch):
    levels, table = [], paths.Scratch.table
    monkeypatch.setattr(paths.Scratch, "table", lambda self, df, name: levels.append(name) or table(self, df, name))
    edges = spark.createDataFrame([("b", "a", "k"), ("c", "b", "k"), ("d", "c", "k")], "child string, parent string, kind string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "node string")
    (r,) = paths.search(edges, ids("a"), ids("b", "d"), "incoming", 3, limit=1).collect()
    assert r.nodes == ["a", "b"] and [n for n in levels if n.startswith("front")] == ["front-1"]
    assert [r.hops for r in paths.search(edges, ids("a"), ids("b", "d"), "incoming", 3, limit=2).collect()] == [1, 3]


def test_a_walk_meets_a_node_once_whatever_the_roots(spark, monkeypatch):
    made, table = {}, report.Scratch.table
    monkeypatch.setattr(report.Scratch, "table", lambda self, df, name: made.setdefault(name, table(self, df, name)))
    pairs = spark.createDataFrame([*((f"line/{k}", "order/1") for k in range(9)), ("order/1", "nation/1"), ("order/1", "region/1"), ("nation/1", "region/1")], "child string, parent string")
    roots = spark.createDataFrame([(f"line/{k}",) for k in range(9)], "artifact_id string")
    rows = {tuple(r) for r in report.walk(pairs, roots, 4, report.Scratch(spark, "t")).collect()}
    assert rows == {(f"line/{k}", n, d, False) for k in range(9) for n, d in ((f"line/{k}", 0), ("order/1", 1), ("nation/1", 2), ("region/1", 3))}
    assert [made[f"walk-{d}"].count() for d in range(4)] == [9, 1, 2, 1]
    made.clear()
    cut = {r.truncated for r in report.walk(pairs, roots, 2, report.Scratch(spark, "t")).collect()}
    assert cut == {True}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_results_are_not_written_with_their_digests(spark, monkeypatch):
    columns, table = set(), report.Scratch.table
    monkeypatch.setattr(report.Scratch, "table", lambda self, df, name: columns.update(df.columns) or table(self, df, name))
    assert catalogue.graph_edges(spark, SF).count() and not columns & {"batch_id", "content_hash"}


def test_nodes_are_exchanged_without_digests_and_lists_as_they_are(no_broadcast):
    nodes = no_broadcast.createDataFrame([("o", "source", 0, "source", "x", "trusted_source", "registry"), ("c", "claim", 1, "support", "y", "derived", "w")], "artifact_id string, role string, generation int, lineage_kind string, content string, trust_state string, authority_id string")
    lists = no_broadcast.createDataFrame([("c", ["o", "o"]), ("c", ["p"])], "child string, parents array<string>")
    artifacts, edges = signing.sign(nodes, lists)
    plan = artifacts._jdf.queryExecution().executedPlan().toString()
    assert "sha2(" not in plan[plan.index("Exchange hashpartitioning(artifact_id") :].split("Scan ", 1)[0]
    pairs = signing.sign(nodes, signing.pairs_of(lists))
    assert sorted(artifacts.collect()) == sorted(pairs[0].collect()) and edges.collect() == pairs[1].collect()
    assert {r.artifact_id: r.parent_count for r in artifacts.collect()} == {"o": 0, "c": 2} and edges.count() == 1
    sets = signing.parent_sets(lists)._jdf.queryExecution().executedPlan().toString()
    assert sets.index("Generate explode") < sets.index("Exchange hashpartitioning(child")


def folders(spark):
    base = Path(shared_dir(spark).removeprefix("file://"))
    return {p.name for p in base.iterdir() if not p.name.startswith("snapshots-")}


def test_a_written_table_leaves_no_shuffle_files(no_broadcast, tmp_path):
    spark = no_broadcast
    files = lambda: {p for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for p in Path(d).rglob("shuffle_*.data")}
    before = files()
    rows = Scratch(spark, "t").table(spark.range(1000).selectExpr("id % 7 k").groupBy("k").count(), "rows")
    assert files() <= before and rows.count() == 7
    assert spark.conf.get(snapshots._CLEANUP, "false") == "false"


def test_tables_on_the_way_are_removed(spark):
    with passing():
        gone = Scratch(spark, "gone")
        gone.table(spark.range(3), "rows")
        with passing():
            Scratch(spark, "inner").table(spark.range(3), "rows")
        assert gone.base.rsplit("/", 1)[1] in folders(spark) and not any(f.startswith("inner-") for f in folders(spark))
    assert gone.base.rsplit("/", 1)[1] not in folders(spark)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_decisions_keep_no_table_of_their_ancestry(spark):
    before = folders(spark)
    decided = catalogue.policy_decision(spark, SF)
    assert not {f.rsplit("-", 5)[0] for f in folders(spark) - before} & {"closure", "results", "contract", "checked", "rechecked", "valid", "ancestry-of-requests"}
    assert decided.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pair_kinds_meets_its_children_once(no_broadcast):
    # the keys of lines for each side, lists by child, nodes for each side, edges by parent, and the groups
    assert exchanges(catalogue.pair_kinds(no_broadcast, SF)) <= 7


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_edges_of_few_kinds_are_those_of_the_whole(spark):
    few, whole = catalogue._signed_kinds(spark, SF, "region", "nation", "supplier"), catalogue.signed(spark, SF)
    assert sorted(few[1].collect()) == sorted(whole[1].where("child_artifact_id like 'nation/%' or child_artifact_id like 'supplier/%'").collect())
    kinds = {p.split("/")[0] for (p,) in few[0].select("artifact_id").collect()}
    assert kinds == {"region", "nation", "supplier"}


def test_repeated_lines_with_a_null_key_are_one_artifact(spark, tmp_path):
    for t in ("region", "part", "nation", "supplier", "customer", "orders"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([(1, 2), (1, 2), (None, 3), (3, None), (None, None)], "l_orderkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(r.artifact_id for r in star.nodes(spark, str(tmp_path)).collect()) == ["lineitem/", "lineitem/1-2", "lineitem/3"]


def test_a_contract_holds_no_set_of_its_paths(no_broadcast):
    rows = no_broadcast.createDataFrame([("a", "$.x", "1"), ("a", "$.x", "1"), ("a", "$.y", "2")], "name string, path string, value string")
    got = json_paths.contract(rows, rows.distinct())
    assert {(r.path, r.ok) for r in got.collect()} == {("$.x", False), ("$.y", True)}
    plain = json_paths.contract(rows, rows.where("value = '2'"))
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_counts_beyond_a_long_meet_only_their_own_edges_again(no_broadcast, monkeypatch):
    """Layers of 64 by 64 parents, lists of numbers: edges are written once, as they are given, and limbs are made from the layer on that needs them."""
    made, table, dealt, partitioned = {}, closure.Scratch.table, [], closure.Scratch.partitioned
    monkeypatch.setattr(closure.Scratch, "table", lambda self, df, name: made.setdefault(name, table(self, df, name)))
    monkeypatch.setattr(closure.Scratch, "partitioned", lambda self, df, name, by: dealt.append((name, df.count())) or partitioned(self, df, name, by))
    nodes = no_broadcast.range(13 * 64).selectExpr("id artifact_id", "int(id div 64) generation", "id < 64 terminal")
    lists = nodes.where("generation > 0").selectExpr("artifact_id child", "transform(sequence(0, 64), x -> if(x = 64, -1L, 64L * (generation - 1) + x)) parents", "generation child_generation", "generation - 1 parent_generation")
    got = {r.artifact_id: (r.value, r.digits) for r in closure.path_counts(nodes, lists).collect()}
    assert got == {k: (64 ** (k // 64) if k // 64 < 11 else None, str(64 ** (k // 64))) for k in range(13 * 64)}
    assert dealt == [("links", 12 * 64), ("nodes", 13 * 64)]
    assert sorted(n for n in made if n.startswith("wide")) == ["wide-11", "wide-12"]


def test_two_nodes_of_one_id_count_twice(spark):
    nodes = spark.createDataFrame([("s", 0, True), ("s", 0, True), *(("a", 1, False),) * 2, ("b", 2, False)], "artifact_id string, generation int, terminal boolean")
    pairs = spark.createDataFrame([("a", "s", 1, 0), ("b", "a", 2, 1)], "child string, parent string, child_generation int, parent_generation int")
    assert sorted((r.artifact_id, r.digits) for r in closure.path_counts(nodes, pairs).collect()) == [("a", "2"), ("a", "2"), ("b", "4"), ("s", "1"), ("s", "1")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_writes_keep_no_copy_of_the_store(spark, monkeypatch):
    made, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: made.append((name, out := table(self, df, name))) or out)
    done, artifacts, edges, _ = catalogue._written(spark, SF)
    left = [(n, df) for n, df in made if n in ("new", "before") or "parent_ids" in df.columns or "auth_tag" in df.columns and n != "old"]
    assert {n for n, _ in left} >= {"new", "new-edges", "plan"}
    gone = {"asked", "decided", "plan", "old"}  # some of these were dropped with what they were made for
    for n, df in left:
        of = "child_artifact_id" if "child_artifact_id" in df.columns else "artifact_id"
        assert n in gone or not df.columns.count("auth_tag") or df.where(~df[of].startswith("digest/")).isEmpty()
    ids = artifacts.select("artifact_id")
    assert ids.where("artifact_id like 'order/%'").count() == spark.read.parquet(f"{SF}/orders.parquet").count() and ids.count() == ids.distinct().count()
    assert edges.where("child_artifact_id like 'order/%'").count() and done.where("detail = 'WRITE_COMMITTED'").count()


def test_a_record_is_compared_by_all_its_fields(spark):
    rows = spark.createDataFrame([("a", None), ("a", ""), (None, "a"), ("a", None)], "x string, y string")
    assert len({bytes(r.d) for r in rows.select(writes._digest(["x", "y"]).alias("d")).collect()}) == 3
    kind = writes._kinds_of(spark.createDataFrame([("order/1",)], "i string"))
    assert spark.createDataFrame([("order/2",), ("order",), (None,)], "i string").where(kind("i")).count() == 2
    assert spark.range(1).select(writes._kinds_of(spark.createDataFrame([], "i string"))("id").alias("k")).first().k is False


def test_longest_depths_of_chains_above_the_generation_bound(spark):
    cfg = LineageConfig(max_generation=4)
    nodes = [(f"n{k}", k) for k in range(41)] + [("m", 41), ("up", 42), ("alone", 9), ("none", None)]
    edges = [(f"n{k}", f"n{k - 1}") for k in range(1, 41)] + [("m", "n40"), ("m", "n3"), ("up", "m"), ("up", "n40"), ("n30", "n2"), ("n40", "none"), ("alone", "gone")]
    got = closure.longest_depths(spark.createDataFrame(nodes, "artifact_id string, generation int"), spark.createDataFrame(edges, "child string, parent string"), cfg)
    assert sorted(map(tuple, got.collect())) == sorted([(f"n{k}", k) for k in range(41)] + [("m", 41), ("up", 42), ("alone", 0), ("none", None)])
