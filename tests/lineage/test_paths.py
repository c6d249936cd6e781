import random

import pytest
from pyspark.sql import functions as F

from lineaspark.operators import paths
from lineaspark.sources.snapshots import Scratch


def plain(edges, sources, targets, most):
    """All simple paths, depth first; ``edges`` are (from, to, kind)."""
    out = []

    def on(nodes, kinds):
        if kinds and (targets is None or nodes[-1] in targets):
            out.append((nodes[0], nodes[-1], len(kinds), nodes, kinds))
        if len(kinds) < most:
            for a, b, k in edges:
                if a == nodes[-1] and b not in nodes:
                    on((*nodes, b), (*kinds, k))

    for s in sorted(set(sources)):
        on((s,), ())
    return sorted(out)


def found(df):
    return sorted((r.source, r.target, r.hops, tuple(r.nodes), tuple(r.kinds)) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_searches_against_depth_first(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(16)]
    edges = sorted({(*rng.sample(names, 2), rng.choice("ab")) for _ in range(34)})  # cycles and parallel kinds too
    df = spark.createDataFrame([(b, a, k) for a, b, k in edges], "child string, parent string, kind string")
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "node string")
    sources, targets, most = rng.sample(names, 3) * 2, [*rng.sample(names, 3), "absent"], 1 + seed
    for some in (targets, None):
        for small in (False, True):
            got = paths.search(df, ids(sources), ids(some) if some else None, "incoming", most, small=small)
            assert found(got) == plain(edges, sources, some, most)
    back = [(b, a, k) for a, b, k in edges if k == "a"]
    assert found(paths.search(df, ids(targets), ids(sources), "outgoing", most, kinds=("a",))) == plain(back, targets, set(sources), most)


def test_each_cap_by_itself(spark):
    df = spark.createDataFrame([(f"c{c}/{k + 1}", f"c{c}/{k}", "k") for c in range(4) for k in range(c + 1)], "child string, parent string, kind string")
    first, last = (spark.createDataFrame([(x,) for x in xs], "node string") for xs in ([f"c{c}/0" for c in range(4)], [f"c{c}/{c + 1}" for c in range(4)]))
    assert [paths.search(df, first, last, "incoming", k).count() for k in range(1, 6)] == [1, 2, 3, 4, 4]


def test_only_prefixes_that_can_arrive_are_made(spark, monkeypatch):
    """A wide graph beside a thin one: of 400 edges only those that lead to the target are of use."""
    rows = [("s", f"wide{k}") for k in range(200)] + [(f"wide{k}", f"on{k}") for k in range(200)] + [("s", "a"), ("a", "b"), ("b", "t"), ("x", "t"), ("wide3", "t")]
    sizes = {}
    table = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: sizes.setdefault(name, (out := table(self, df, name)).count()) * 0 or out)
    df = spark.createDataFrame([(b, a, "k") for a, b in rows], "child string, parent string, kind string")
    got = paths.search(df, *(spark.createDataFrame([(x,)], "node string") for x in "st"), "incoming", 3)
    assert found(got) == [("s", "t", 2, ("s", "wide3", "t"), ("k", "k")), ("s", "t", 3, ("s", "a", "b", "t"), ("k", "k", "k"))]
    assert sizes["useful"] == 5 and max(v for k, v in sizes.items() if k.startswith("front")) == 2


def test_joins_grow_with_the_length(spark, monkeypatch):
    def joins(most):
        n, table = [0], Scratch.table

        def counted(self, df, name):
            n[0] += df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
            return table(self, df, name)

        with monkeypatch.context() as m:
            m.setattr(Scratch, "table", counted)
            chain = spark.range(15).select(F.concat(F.lit("n"), F.col("id") + 1).alias("child"), F.concat(F.lit("n"), "id").alias("parent"), F.lit("k").alias("kind"))
            out = paths.search(chain, *(spark.createDataFrame([(x,)], "node string") for x in ("n0", f"n{most}")), "incoming", most)
            assert out.count() == 1
            return n[0] + out._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    four, eight, twelve = (joins(k) for k in (4, 8, 12))
    assert twelve - eight <= eight - four + 1


def test_lengths_and_directions_that_are_none(spark):
    e = spark.createDataFrame([("b", "a", "k")], "child string, parent string, kind string")
    n = spark.createDataFrame([("a",)], "node string")
    for bad in ({"max_len": 0}, {"direction": "sideways"}):
        with pytest.raises(ValueError):
            paths.search(e, n, None, **bad)
    assert paths.search(e.where("false"), n, None).collect() == []


def test_a_step_is_written_for_the_hops_that_can_take_it(spark, monkeypatch):
    """Two ways to each line, of two and three hops: no step of the first is met again by the third hop, and the last hop's paths aren't written."""
    rows = [("nation/1", f"supplier/{k}") for k in range(3)] + [(f"supplier/{k}", f"line/{k}") for k in range(3)] + [("nation/1", "customer/1"), ("customer/1", "order/1")] + [("order/1", f"line/{k}") for k in range(3)] + [(f"part/{k}", f"line/{k}") for k in range(3)]
    sizes, table = {}, Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: sizes.setdefault(name, (out := table(self, df, name)).count()) * 0 or out)
    df = spark.createDataFrame([(b, a, "k") for a, b in rows], "child string, parent string, kind string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "node string")
    got = paths.search(df, ids("nation/1"), ids(*(f"line/{k}" for k in range(3))), "incoming", 3, per_pair=1)
    assert found(got) == [("nation/1", f"line/{k}", 2, ("nation/1", f"supplier/{k}", f"line/{k}"), ("k", "k")) for k in range(3)]
    assert [sizes[f"taken-{h}"] for h in (1, 2, 3)] == [4, 4, 3] and sizes["useful"] == 11 and "front-3" not in sizes
    assert found(paths.search(df, ids("line/1"), ids("nation/1"), "incoming", 3)) == []
