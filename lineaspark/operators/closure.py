"""Bounded ancestry of many roots at once.

Local verdicts are made once a node and once an edge (``signing.checked``); the
frontier loop then only walks.  A root leaves the frontier as soon as it has a
verdict.  Depth is the longest path, so a verdict never depends on edge order;
with several faults the one at the least depth counts, and of those the one at
the least artifact id.  A root that has met more distinct nodes than the cap by
some depth is unresolved, whatever it would have met from that depth on.  Each
level is written, so no plan holds more than one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, LineageConfig
from ..functions.columns import is_artifact_id
from ..sources.snapshots import Scratch
from .signing import few, pairs_of

#: In the order in which a node's checks are made.
_STEPS = ("SYSTEM_ERROR", "IDENTITY_OR_AUTHENTICITY", "TERMINAL_STRUCTURE", "DEPTH_CAP_REACHED", "DERIVED_STRUCTURE", "EDGE_OR_PARENT")
_CAP = "CLOSURE_NODE_CAP_REACHED"


def walk(nodes: DataFrame, roots: DataFrame, max_depth: int | None = None, cfg: LineageConfig = DEFAULT, node_cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts as :func:`verify` gives them, ``reach``: ``root``, ``node`` and longest ``depth`` of the verified roots).

    ``nodes`` come from ``signing.checked``, with their parents.  A level is one
    join with the nodes and one exchange by root, which drops repeats and counts.
    """
    max_depth = cfg.max_generation if max_depth is None else max_depth
    cap = cfg.max_closure_nodes if node_cap is None else node_cap
    scratch = Scratch(nodes.sparkSession, "closure")
    start = roots.select(F.col("artifact_id").alias("root")).distinct()
    if not (0 <= max_depth <= cfg.max_generation and 1 <= cap <= cfg.max_closure_nodes):
        detail = F.when(is_artifact_id(F.col("root")), "INVALID_VERIFICATION_BOUNDS").otherwise("INVALID_ARTIFACT_ID")
        none = scratch.table(start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).where("false"), "reach")
        return start.select(F.col("root").alias("artifact_id"), F.lit("INVALID").alias("classification"), detail.alias("detail"), F.lit(None).cast("string").alias("fault_artifact_id"), *(F.lit(None).cast("bigint").alias(c) for c in _COUNTS)), none
    step = (
        F.when(F.col("dangling"), 0).when(~F.col("node_ok"), 1).when(F.col("terminal") & ~F.col("structure_ok"), 2)
        .when(F.coalesce(~F.col("terminal"), F.lit(True)), F.when(~F.col("structure_ok"), 4).when(~F.col("edges_ok"), 5))
    )
    sound = F.when(step.isNull() & ~F.col("terminal"), F.col("parents"))
    few = scratch.table(nodes.select(F.col("artifact_id").alias("node"), "terminal", step.alias("step"), F.coalesce(F.size(sound), F.lit(0)).alias("out"), sound.alias("parents")), "few")
    asked = scratch.table(start.join(few.select(F.col("node").alias("root"), F.lit(True).alias("stored")), "root", "left").select("root", F.coalesce("stored", F.lit(False)).alias("stored"), is_artifact_id(F.col("root")).alias("good_id")), "asked")
    front = asked.where("stored and good_id").select("root", F.col("root").alias("node"), F.lit(1).cast("bigint").alias("met"))
    levels: list[DataFrame] = []
    over: list[DataFrame] = []
    for depth in range(max_depth + 1):
        at_cap = F.lit(depth >= max_depth) & F.coalesce(~F.col("terminal"), F.lit(True)) & F.coalesce(F.col("step") > 2, F.lit(True))
        level = front.join(few, "node").withColumn("step", F.when(at_cap, 3).otherwise(F.col("step"))).withColumn("parents", F.when(F.col("step").isNull(), F.col("parents")))
        level = scratch.table(level.select("root", "node", "terminal", "step", "out", "met", "parents"), f"level-{depth}")
        levels.append(level.select("root", "node", "terminal", "step", "out", F.lit(depth).alias("depth")))
        most, going = level.agg(F.max("met"), F.count_if(F.size("parents") > 0)).first()
        gone = level.where("step is not null").select("root")
        if (most or 0) > cap:  # of the roots that have met so many nodes, repeats counted, those that have distinct ones
            suspects = level.where(F.col("met") > cap).select("root").distinct()
            every = reduce(DataFrame.unionByName, (x.select("root", "node") for x in levels)).join(suspects, "root", "left_semi")
            beyond = every.groupBy("root").agg(F.count_distinct("node").alias("n")).where(F.col("n") > cap)
            over.append(scratch.table(beyond.select("root"), f"over-{depth}"))
            gone = gone.unionByName(over[-1])
        if depth == max_depth or not going:
            break
        mine = Window.partitionBy("root")
        nxt = level.where(F.size("parents") > 0).join(gone.distinct(), "root", "left_anti").select("root", "met", F.explode("parents").alias("node"))
        front = nxt.repartition("root").dropDuplicates(["root", "node"]).select("root", "node", (F.col("met") + F.count("*").over(mine)).alias("met"))
    walked = reduce(DataFrame.unionByName, levels).repartition("root")
    per_node = walked.groupBy("root", "node").agg(F.max("depth").alias("depth"), F.first("terminal").alias("terminal"), F.first("out").alias("out"), F.min(F.struct("depth", "node", "step")).alias("at"), F.max("step").alias("step"))
    fault = F.min(F.when(F.col("step").isNotNull(), F.struct(F.col("at.depth").alias("depth"), "node", "step"))).alias("fault")
    sums = per_node.groupBy("root").agg(F.count("*").alias("node_count"), F.count_if("terminal").alias("source_count"), F.max("depth").alias("deepest_hops"), F.sum("out").alias("edge_count"), fault)
    row = asked.join(sums, "root", "left")
    if over:
        row = row.join(reduce(DataFrame.unionByName, over).distinct().withColumn("_over", F.lit(True)), "root", "left")
    names = F.array(*map(F.lit, _STEPS))
    detail = F.when(~F.col("good_id"), "INVALID_ARTIFACT_ID").when(~F.col("stored"), "ARTIFACT_NOT_FOUND")
    if over:
        detail = detail.when(F.col("_over"), _CAP)
    detail = detail.when(F.col("fault").isNotNull(), F.element_at(names, F.col("fault.step") + 1)).otherwise("ANCESTRY_VERIFIED")
    kind = (
        F.when(F.col("detail") == "ARTIFACT_NOT_FOUND", "MISSING").when(F.col("detail") == "SYSTEM_ERROR", "SYSTEM_ERROR")
        .when(F.col("detail").isin("DEPTH_CAP_REACHED", _CAP), "UNRESOLVED").when(F.col("detail") == "ANCESTRY_VERIFIED", "VERIFIED").otherwise("INVALID")
    )
    only = lambda c: F.when(F.col("classification") == "VERIFIED", F.coalesce(F.col(c), F.lit(0)).cast("bigint")).alias(c)
    verdicts = row.withColumn("detail", detail).withColumn("classification", kind).select(
        F.col("root").alias("artifact_id"), "classification", "detail", F.when(F.col("detail") != _CAP, F.col("fault.node")).alias("fault_artifact_id"), *map(only, _COUNTS),
    )
    return verdicts, per_node.select("root", "node", "depth")


_COUNTS = ("node_count", "edge_count", "source_count", "deepest_hops")


def verify(nodes: DataFrame, roots: DataFrame, max_depth: int | None = None, cfg: LineageConfig = DEFAULT, node_cap: int | None = None) -> DataFrame:
    """A row for each distinct ``artifact_id`` of ``roots``: ``classification``, ``detail``, ``fault_artifact_id``, counts and depth.

    ``nodes`` come from ``signing.checked``.  Classifications are VERIFIED,
    INVALID, UNRESOLVED, MISSING and SYSTEM_ERROR; an id that isn't one is
    INVALID, and so is every root if the bounds aren't within the settings'.
    Counts are of what was walked, and null unless VERIFIED.
    """
    return walk(nodes, roots, max_depth, cfg, node_cap)[0]


def integrity(verified: DataFrame) -> DataFrame:
    """The coarse answer: PASS, or why not, all that isn't a fault of the system being one reason."""
    return verified.select(
        "artifact_id", F.when(F.col("classification") == "VERIFIED", "PASS").otherwise("BLOCK").alias("status"),
        F.when(F.col("classification") == "VERIFIED", "PROVENANCE_VERIFIED").when(F.col("classification") == "SYSTEM_ERROR", "VERIFICATION_FAILED").otherwise("ARTIFACT_NOT_AUTHENTIC").alias("detail"),
    )


def _by_generation(nodes: DataFrame, edges: DataFrame, first: Column, step, rest: Column, name: str, cfg: LineageConfig) -> DataFrame:
    """Fold values up the graph, a generation at a time (see :func:`_folded`)."""
    done = _folded(nodes, edges, first, step, rest, name, cfg)[0]
    return reduce(DataFrame.unionByName, done.values()) if done else nodes.select("artifact_id", rest.alias("value"))


def _folded(nodes: DataFrame, edges: DataFrame, first: Column, step, rest: Column, name: str, cfg: LineageConfig) -> tuple[dict[int, DataFrame], dict[tuple[int, int], DataFrame], Scratch]:
    """(the values of each generation, the edges between each two as they were written, where this lies).

    Edges are written once, in a folder for each pair of generations that they
    join, and a generation reads its own folders and the values of the
    generations below that these name.  Instead of a ``parent`` they may have
    ``parents``, a list all of one generation, and are then written as lists.  ``step`` gives a child's value from its
    parents' by aggregation; nodes of no generation, or one that isn't allowed,
    get ``rest`` under -1.
    """
    scratch = Scratch(nodes.sparkSession, name)
    spark = nodes.sparkSession
    if "child_generation" not in edges.columns:
        g = nodes.select("artifact_id", "generation")
        edges = edges.join(g.withColumnsRenamed({"artifact_id": "child", "generation": "child_generation"}), "child").join(g.withColumnsRenamed({"artifact_id": "parent", "generation": "parent_generation"}), "parent")
    inside = F.col("generation").between(0, cfg.max_generation)
    nodes = nodes.withColumn("_slice", F.when(inside, F.col("generation")).otherwise(-1))
    links = edges.where((F.col("parent_generation") >= 0) & (F.col("parent_generation") < F.col("child_generation")) & (F.col("child_generation") <= cfg.max_generation))
    links = links.select("child", *(c for c in ("parent", "parents") if c in links.columns), F.col("child_generation").alias("high"), F.col("parent_generation").alias("low"))
    written = {at: spark.read.schema(links.drop("high", "low").schema).parquet(path) for at, path in scratch.partitioned(links, "links", ["high", "low"]).items()}
    pairs = {at: pairs_of(x) for at, x in written.items()}
    slices = scratch.partitioned(nodes, "nodes", ["_slice"])
    done: dict[int, DataFrame] = {}
    for (g,) in sorted(slices):
        here = spark.read.schema(nodes.drop("_slice").schema).parquet(slices[g,])
        if g < 0:
            now = here.select("artifact_id", rest.alias("value"))
        elif below := [low for high, low in sorted(pairs) if high == g and low in done]:
            up = reduce(DataFrame.unionByName, (pairs[g, low].join(done[low].select(F.col("artifact_id").alias("parent"), F.col("value").alias("parent_value")), "parent", "left") for low in below))
            now = here.join(up.groupBy("child").agg(step.alias("_up")), F.col("artifact_id") == F.col("child"), "left").select("artifact_id", first.alias("value"))
        else:
            now = here.withColumn("_up", F.lit(None)).select("artifact_id", first.alias("value"))
        done[g] = scratch.table(now, f"generation-{g}")
    return done, pairs, scratch


def valid_closures(nodes: DataFrame, edges: DataFrame, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """(``artifact_id``, ``value`` boolean): a node is valid if it and its edges are and all its parents are; one without an allowed generation isn't."""
    own = F.col("node_ok") & F.col("structure_ok") & F.col("edges_ok") & ~F.col("dangling")
    value = own & F.coalesce(F.col("_up").cast("boolean"), F.lit(True))
    nodes = nodes.select("artifact_id", "generation", "node_ok", "structure_ok", "edges_ok", "dangling")  # its digests and parents aren't dealt
    return _by_generation(nodes, edges, value, F.bool_and(F.coalesce("parent_value", F.lit(False))), F.lit(False), "valid", cfg)


def revalidated(valid: DataFrame, nodes: DataFrame, links: DataFrame, checked_anew: DataFrame, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """What :func:`valid_closures` gives for ``nodes`` and ``links``, from what it gave before (``valid``) and the nodes that were ``checked_anew``.

    Values are made anew for these, and then, a round at a time, only for
    children of nodes whose value has changed; edges go up in generations, so rounds end.
    """
    scratch = Scratch(nodes.sparkSession, "revalidated")
    own = F.coalesce(F.col("node_ok") & F.col("structure_ok") & F.col("edges_ok") & ~F.col("dangling") & F.col("generation").between(0, cfg.max_generation), F.lit(False))
    before = valid.select("artifact_id", F.col("value").alias("_before"))
    front = scratch.table(checked_anew.select("artifact_id").distinct(), "front-0")
    now = scratch.table(front.withColumn("value", F.lit(None).cast("boolean")).where("false"), "now-0")  # of nodes that have changed
    for k in range(1, cfg.max_generation + 3):
        at = few(front)
        here = nodes.join(at, "artifact_id", "left_semi").select("artifact_id", own.alias("own"))
        up = links.join(at.select(F.col("artifact_id").alias("child")), "child", "left_semi").select("child", F.col("parent").alias("artifact_id"))
        asked = few(scratch.table(up.select("artifact_id").distinct(), f"asked-{k}"))
        # full joins, as a union of two exchanged sides can't take part in another join: adaptive execution may deal them differently
        known = before.join(asked, "artifact_id", "left_semi").join(now, "artifact_id", "full_outer").select("artifact_id", F.coalesce("value", "_before").alias("parent_value"))
        sums = up.join(known, "artifact_id", "left").groupBy("child").agg(F.bool_and(F.coalesce("parent_value", F.lit(False))).alias("_up")).withColumnRenamed("child", "artifact_id")
        made = here.join(sums, "artifact_id", "left").select("artifact_id", (F.col("own") & F.coalesce("_up", F.lit(True))).alias("value"))
        old = before.join(at, "artifact_id", "left_semi").join(now.withColumnRenamed("value", "_now"), "artifact_id", "full_outer").select("artifact_id", F.coalesce("_now", "_before").alias("_old"))
        other = scratch.table(made.join(old, "artifact_id", "left").where(~F.col("value").eqNullSafe(F.col("_old"))).select("artifact_id", "value"), f"other-{k}")
        now = scratch.table(now.join(other, "artifact_id", "left_anti").unionByName(other), f"now-{k}")
        front = scratch.table(links.join(few(other).select(F.col("artifact_id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("artifact_id")).distinct(), f"front-{k}")
        if front.isEmpty():
            break
    stay = valid.join(now, "artifact_id", "left_anti").join(nodes.select("artifact_id"), "artifact_id", "left_semi")
    return stay.select("artifact_id", "value").unionByName(now)


#: Digits of a limb, and limbs of a count; 64 generations of 64 parents each need 116 digits.
_DIGITS, _LIMBS = 9, 13


def _carried(sums: Column) -> Column:
    """Limbs, the least first, below 10^9 each; the last one says whether there was more."""
    whole = F.lit(10**_DIGITS).cast("bigint")
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["carry"] + x
        rest = total % whole
        return F.struct(F.round((total - rest) / whole).cast("bigint").alias("carry"), F.concat(acc["out"], F.array(rest)).alias("out"))

    return F.aggregate(F.slice(sums, 1, _LIMBS), start, step, lambda acc: F.concat(acc["out"], F.array(F.when(acc["carry"] + F.element_at(sums, _LIMBS + 1) > 0, 1).otherwise(0).cast("bigint"))))


def path_counts(nodes: DataFrame, edges: DataFrame, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """(``artifact_id``, ``value``, ``digits``): how many paths lead to sources; nodes need ``generation`` and ``terminal``.

    ``digits`` is the count as decimal text, exact up to 117 digits and ``many``
    beyond them; ``value`` is the count where a long holds it, else null.  Both
    are null without an allowed generation.
    """
    # longs first, -1 where they don't do; limbs then for those alone, over the same edges
    beyond = F.lit(-1).cast("bigint")
    up = F.when(F.min("parent_value") < 0, beyond).otherwise(F.coalesce(F.try_sum("parent_value"), F.when(F.count("parent_value") > 0, beyond)))
    value = F.when(F.col("terminal"), F.lit(1)).otherwise(F.coalesce(F.col("_up").cast("bigint"), F.lit(0))).cast("bigint")
    done, pairs, scratch = _folded(nodes, edges, value, up, F.lit(None).cast("bigint"), "ways", cfg)
    if not done:
        return nodes.select("artifact_id", F.lit(None).cast("bigint").alias("value"), F.lit(None).cast("string").alias("digits"))
    # a parent's limb is a part of its long, unless it has limbs of its own
    part = lambda k: F.expr(f"(n div {10 ** (_DIGITS * k)}L) % {10**_DIGITS}L") if k < 3 else F.lit(0).cast("bigint")
    sums = F.array(*(F.sum(F.coalesce(F.col("limbs")[k], part(k))) for k in range(_LIMBS + 1)))
    wide: dict[int, DataFrame] = {}
    for g in sorted(done):
        over = done[g].where("value < 0").select("artifact_id")
        if g < 0 or over.isEmpty():
            continue
        above = lambda low: done[low].where("value >= 0").select(F.col("artifact_id").alias("parent"), F.col("value").alias("n"), F.lit(None).cast("array<bigint>").alias("limbs"))
        more = lambda low: [wide[low].select(F.col("artifact_id").alias("parent"), F.lit(0).cast("bigint").alias("n"), F.col("value").alias("limbs"))] if low in wide else []
        rows = [pairs[at].join(x, "parent").select("child", "n", "limbs") for at in sorted(pairs) if at[0] == g and at[1] in done for x in (above(at[1]), *more(at[1]))]
        rows = reduce(DataFrame.unionByName, rows).groupBy("child").agg(sums.alias("_up"))
        wide[g] = scratch.table(over.join(rows, F.col("artifact_id") == F.col("child")).select("artifact_id", _carried(F.col("_up")).alias("value")), f"wide-{g}")
    ways = reduce(DataFrame.unionByName, done.values())
    narrow = ways.select("artifact_id", "value", F.col("value").cast("string").alias("digits"))
    if not wide:
        return narrow
    text = F.array_join(F.transform(F.reverse(F.slice("value", 1, _LIMBS)), lambda x: F.lpad(x.cast("string"), _DIGITS, "0")), "")
    digits = F.when(F.element_at("value", _LIMBS + 1) > 0, "many").otherwise(F.regexp_replace(text, "^0+(?=.)", ""))
    large = reduce(DataFrame.unionByName, wide.values()).select("artifact_id", digits.try_cast("bigint").alias("value"), digits.alias("digits"))
    return narrow.where("value is null or value >= 0").unionByName(large)


def longest_depths(nodes: DataFrame, edges: DataFrame, cfg: LineageConfig = DEFAULT) -> DataFrame:
    """(``artifact_id``, ``value``): hops of the longest path to a node without parents; null without a generation.

    Nodes of the allowed generations are folded, one generation at a time; those above them, of any number of generations, by :func:`_tall_depths`.
    """
    if "child_generation" not in edges.columns:
        g = nodes.select("artifact_id", "generation")
        edges = edges.join(g.withColumnsRenamed({"artifact_id": "child", "generation": "child_generation"}), "child").join(g.withColumnsRenamed({"artifact_id": "parent", "generation": "parent_generation"}), "parent")
    value = F.coalesce(F.col("_up").cast("bigint") + 1, F.lit(0)).cast("bigint")
    high = F.coalesce(F.col("generation") > cfg.max_generation, F.lit(False))
    depths = _by_generation(nodes.where(~high), edges, value, F.max("parent_value"), F.lit(None).cast("bigint"), "depth", cfg)
    scratch = Scratch(nodes.sparkSession, "tall")
    tall = scratch.table(nodes.where(high).select("artifact_id"), "nodes")
    if tall.isEmpty():
        return depths
    links = edges.where((F.col("parent_generation") >= 0) & (F.col("parent_generation") < F.col("child_generation")) & (F.col("child_generation") > cfg.max_generation))
    more = _tall_depths(tall, links, depths, scratch)
    return depths.unionByName(tall.join(more, "artifact_id", "left").select("artifact_id", "value"))


def _tall_depths(tall: DataFrame, links: DataFrame, depths: DataFrame, scratch: Scratch) -> DataFrame:
    """(``artifact_id``, ``value``) of the nodes above ``depths``, whose ``links`` are pairs that end in these or in nodes that ``depths`` has.

    A term (``x``, ``p``, ``w``) says that x is ``w`` or more above p, or above the
    ground if p is null.  In each round a parent that has one term left to
    another is replaced by its own terms, so a chain takes as many rounds as its length has bits, and
    any other graph at most one for each of its levels.
    """
    known = depths.groupBy("artifact_id").agg(F.max("value").alias("n")).withColumnRenamed("artifact_id", "parent")
    own = tall.select(F.col("artifact_id").alias("x"), F.lit(None).cast("string").alias("p"), F.lit(0).cast("bigint").alias("w"))
    met = links.join(known, "parent", "left").select(F.col("child").alias("x"), F.when(F.col("n").isNull(), F.col("parent")).alias("p"), (F.coalesce("n", F.lit(0)) + 1).cast("bigint").alias("w"))
    once = lambda rows: rows.groupBy("x", "p").agg(F.max("w").alias("w"))
    terms, k = scratch.table(once(own.unionByName(met)), "terms-0"), 0
    left = F.col("p").isNotNull()
    while not terms.where(left).isEmpty():
        above = terms.groupBy(F.col("x").alias("p")).agg(F.max(F.when(~left, F.col("w"))).alias("_ground"), F.count_if(left).alias("_n"), F.max("p").alias("_p"), F.max(F.when(left, F.col("w"))).alias("_w"))
        ground = F.struct(F.lit(None).cast("string").alias("p"), (F.col("w") + F.col("_ground")).alias("w"))
        on = F.struct(F.col("_p").alias("p"), (F.col("w") + F.col("_w")).alias("w"))
        next_ = F.when(F.col("_n") == 0, F.array(ground)).when(F.col("_n") == 1, F.array(ground, on)).otherwise(F.array(F.struct("p", "w")))
        moved = terms.where(left).join(above, "p").select("x", F.explode(next_).alias("t")).select("x", "t.*")
        k += 1
        terms = scratch.table(once(terms.where(~left).unionByName(moved)), f"terms-{k}")
        scratch.drop(f"terms-{k - 1}")
    return terms.select(F.col("x").alias("artifact_id"), F.col("w").alias("value"))


def recomputed_generations(edges: DataFrame) -> DataFrame:
    """(``artifact_id``, ``generation``): one more than the highest parent's."""
    return edges.groupBy(F.col("child_artifact_id").alias("artifact_id")).agg((F.max("parent_generation") + 1).alias("generation"))
