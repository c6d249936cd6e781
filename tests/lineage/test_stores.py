import json
import random

import pytest
from pyspark.sql import functions as F

from lineaspark.functions import json_paths
from lineaspark.operators import lookups, report, writes
from lineaspark.schema import ARTIFACTS
from lineaspark.sources.buckets import Buckets
from lineaspark.sources.versions import StaleVersion, Versions

from .test_lineage import graph


def files(tmp_path):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in (tmp_path / "s" / "data").rglob("*.parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = Buckets(spark, f"file://{tmp_path}/s", "k", 8)
    row = lambda *k: spark.createDataFrame([(x, f"new {x}") for x in k], "k bigint, v string")
    assert store.create(spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v"))) == 1
    before = files(tmp_path)
    merge = lambda old, new: writes.create_only(old, new, "k")
    assert store.upsert(row(3, 100, 100), merge) == 2
    after = files(tmp_path)
    assert before.items() <= after.items() and 1 <= len(set(after) - set(before)) <= 2
    parts = {v: {p["bucket"]: p["folder"] for p in store.versions.manifest(v)["tables"]["rows"]} for v in (1, 2)}
    assert sum(parts[1][b] != parts[2].get(b) for b in parts[1]) <= 2
    assert dict(map(tuple, store.read(2).collect())) == {**dict.fromkeys(range(100), "old"), 100: "new 100"} and store.read(1).count() == 100
    newer = spark.createDataFrame([(5, "x")], "k bigint, v string")
    assert Buckets(spark, f"file://{tmp_path}/s", "k", 99).upsert(newer, lambda old, new: old.join(new, "k", "left_anti").unionByName(new)) == 3
    assert dict(map(tuple, store.read().collect()))[5] == "x" and store.read().count() == 101
    with pytest.raises(StaleVersion):
        store.create(newer)


def test_buckets_of_no_rows(spark, tmp_path):
    store = Buckets(spark, f"file://{tmp_path}/s", "k", 4)
    none = spark.createDataFrame([], "k bigint, v string")
    store.create(none)
    assert store.read().collect() == [] and store.read().columns == ["k", "v"]
    store.upsert(none, lambda old, new: old)
    store.upsert(spark.createDataFrame([(1, "a"), (None, "b")], "k bigint, v string"), lambda old, new: old.unionByName(new))
    assert sorted(map(repr, map(tuple, store.read().collect()))) == ["(1, 'a')", "(None, 'b')"]
    store.upsert(spark.createDataFrame([(1, "")], "k bigint, v string"), lambda old, new: old.join(new, "k", "left_anti"))
    assert [tuple(r) for r in store.read().collect()] == [(None, "b")]


def test_a_point_lookup_reads_one_row_group(spark, tmp_path):
    artifacts, _, _ = graph(spark, random.Random(2), 400)
    store = Versions(spark, f"file://{tmp_path}/s")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    version = store.commit({"artifacts": artifacts}, sorted_by={"artifacts": "vertex_id"})
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = store.read("artifacts", ARTIFACTS, version)
    r = artifacts.first()
    found = lookups.by_vertex(stored, r.vertex_id)
    assert found.count() == 1 and found.first().artifact_id == r.artifact_id
    scanned = [m for m in _scan_metrics(found) if m]
    assert sum(scanned) < 400
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(vertex_id,{r.vertex_id})" in plan
    bounds = stored.groupBy(F.input_file_name()).agg(F.min("vertex_id").alias("a"), F.max("vertex_id").alias("b")).orderBy("a").collect()
    assert len(bounds) > 1 and all(x.b < y.a for x, y in zip(bounds, bounds[1:], strict=False))


def _scan_metrics(df):
    """Rows that each scan of an executed plan gave."""
    df.collect()
    out, queue = [], [df._jdf.queryExecution().executedPlan()]
    while queue:
        node = queue.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            queue.append(node.executedPlan())
            continue
        if "QueryStage" in node.getClass().getSimpleName():
            queue.append(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            out.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        queue += [kids.apply(k) for k in range(kids.size())]
    return out


def at(value, path="$"):
    yield path, value
    inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in inner:
        yield from at(v, f"{path}[{k}]" if isinstance(k, int) else f"{path}.{k}" if k.replace("_", "").isalnum() and k.isascii() else f"{path}[{json.dumps(k, ensure_ascii=False)}]")


def test_all_paths_of_any_json(spark):
    rng = random.Random(7)

    def made(depth):
        kind = rng.randrange(7 if depth < 6 else 5)
        if kind == 5:
            return {rng.choice(["a", "b_1", "c d", "é", 'q"', ""]): made(depth + 1) for _ in range(rng.randrange(4))}
        return [made(depth + 1) for _ in range(rng.randrange(4))] if kind == 6 else [None, True, rng.randrange(99), "x\n\"é", ""][kind]

    values = [{"a": made(1), "b": made(1)} for _ in range(40)] + [[], {}, 7, None, "x"]
    rows = [(f"r{k}", json.dumps(v)) for k, v in enumerate(values)] + [("bad", "{"), ("twice", '{"a":1,"a":2}'), ("null", None)]
    got = sorted((r.name, r.path, r.value) for r in json_paths.paths(spark.createDataFrame(rows, "name string, raw string")).collect())
    text = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got == sorted((f"r{k}", p, text(x)) for k, v in enumerate(values) for p, x in at(v))


def test_a_contract_of_paths(spark):
    found = json_paths.paths(spark.createDataFrame([("a", '{"x":[1,{"y":"1"}]}'), ("b", '{"x":1}'), ("b", '{"x":1}')], "name string, raw string"))
    want = [("a", "$.x[0]", "1", True), ("a", "$.x[1].y", '"1"', True), ("a", "$.x[1].y", "1", False), ("a", "$.z", "1", False), ("b", "$.x", "1", False), ("c", "$", "1", False)]
    got = json_paths.contract(found, spark.createDataFrame([w[:3] for w in want], "name string, path string, value string")).collect()
    assert sorted(map(tuple, got)) == sorted((n, p, ok) for n, p, _, ok in want)


def test_nodes_are_shown_by_generation_and_language(spark):
    rows = [("r", x, "Claim", g, "derived", False) for x, g in (("b", 0), ("B", 0), ("a", 0), ("é", 0), ("f", 0), ("a", 1), ("Z", 2))]
    (shown,) = report.displayed(spark.createDataFrame(rows, "root string, artifact_id string, label string, generation int, trust_state string, is_root boolean")).collect()
    assert [(n.generation, n.artifact_id) for n in shown.nodes] == [(0, "a"), (0, "b"), (0, "B"), (0, "é"), (0, "f"), (1, "a"), (2, "Z")]


