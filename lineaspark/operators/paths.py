"""Paths between sources and targets, and what may be asked of them.

A search is bounded from both ends.  The steps that each hop can take from the
sources come first, a written level at a time, and of these, from the last hop
back, those from which a target is within reach.  A prefix is extended only over
such steps.  So no more prefixes are made than lead to a target, but for
those that meet themselves, and joins grow with the length and not with its square.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.snapshots import Scratch, tidy


#: Parts in which steps are stored, by what stands before the first slash of the id that they leave.
_PARTS = 16


def _part(node: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(node, "/", 1)), F.lit(_PARTS)).cast("int")


def _useful(steps: DataFrame, sources: DataFrame, targets: DataFrame | None, max_len: int, scratch: Scratch) -> list[DataFrame]:
    """For each hop the steps (``_from``, ``_to``, ``_kind``) that a path can take there: ``_hit`` where it may end, ``_on`` where it can go on.

    Steps are written in parts, and a hop reads those that its nodes fall in.  Forward
    it is written which steps each hop can take, and then backward which of them can still arrive.
    """
    steps = steps.where("_from is not null and _to is not null")
    if targets is None:
        steps = steps.withColumn("_hit", F.lit(True))
    else:  # marked here, where steps often lie by the id that they lead to
        steps = steps.join(targets.select(F.col("node").alias("_to"), F.lit(True).alias("_hit")).distinct(), "_to", "left").select("_from", "_to", "_kind", F.coalesce("_hit", F.lit(False)).alias("_hit"))
    path = f"{scratch.base}/steps"
    with tidy(steps.sparkSession):
        steps.withColumn("_part", _part(F.col("_from"))).write.partitionBy("_part").parquet(path)
    steps = steps.sparkSession.read.schema(T.StructType([*steps.schema, T.StructField("_part", T.IntegerType())])).parquet(path)  # ids may be numbers
    known = [r[0] for r in steps.select("_part").distinct().collect()]  # at most _PARTS
    onward = _part(F.col("_to")).isin(known) if known else F.lit(False)  # ids that some step may leave
    front, taken = scratch.table(sources.select("node").where("node is not null").distinct(), "before-0"), []
    for h in range(1, max_len + 1):
        parts = [r[0] for r in front.select(_part(F.col("node"))).distinct().collect() if r[0] in known]
        if not parts:
            break
        ahead = steps.where(F.col("_part").isin(parts)).join(front.withColumnRenamed("node", "_from"), "_from", "left_semi").select("_from", "_to", "_kind", "_hit")
        taken.append(scratch.table(ahead, f"taken-{h}"))
        if h < max_len:
            front = scratch.table(taken[-1].where(onward).select(F.col("_to").alias("node")).distinct(), f"before-{h}")
    if not taken or targets is None:
        return [x.withColumn("_on", F.lit(True)) for x in taken]
    out = [taken[-1].where("_hit").withColumn("_on", F.lit(False))]
    for h in range(len(taken) - 1, 0, -1):
        after = scratch.table(out[0].select(F.col("_from").alias("_to")).distinct(), f"after-{h}").withColumn("_on", F.lit(True))
        last = taken[h - 1].where(~onward & F.col("_hit")).withColumn("_on", F.lit(False))
        more = taken[h - 1].where(onward).join(after, "_to", "left").select("_from", "_to", "_kind", "_hit", F.coalesce("_on", F.lit(False)).alias("_on")).where("_hit or _on")
        out.insert(0, last.unionByName(more))
    useful = scratch.table(reduce(DataFrame.unionByName, (x.withColumn("_hop", F.lit(h)) for h, x in enumerate(out, 1))), "useful")
    return [useful.where(F.col("_hop") == h).drop("_hop") for h in range(1, len(out) + 1)]


def _start(sources: DataFrame) -> DataFrame:
    return sources.select(F.col("node").alias("source"), F.col("node").alias("at"), F.array("node").alias("nodes"), F.array().cast("array<string>").alias("kinds")).distinct()


def _extended() -> list[Column]:
    return ["source", F.col("_to").alias("at"), F.concat("nodes", F.array("_to")).alias("nodes"), F.concat("kinds", F.array("_kind")).alias("kinds")]


def _at_once(steps: DataFrame, sources: DataFrame, targets: DataFrame | None, max_len: int) -> DataFrame:
    """All paths by one statement: each join keeps every path as it is and adds those that are one hop longer."""
    steps = F.broadcast(steps.select("_from", F.struct("_to", "_kind").alias("_s")))
    rows = _start(sources).withColumn("_on", F.lit(True))
    for _ in range(max_len):
        rows = rows.withColumn("_go", F.explode(F.when(F.col("_on"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
        rows = rows.withColumn("_key", F.when(F.col("_go"), F.col("at"))).join(steps, F.col("_key") == F.col("_from"), "left")
        rows = rows.where(~F.col("_go") | (F.col("_s").isNotNull() & ~F.array_contains("nodes", F.col("_s._to")))).withColumn("_to", F.col("_s._to")).withColumn("_kind", F.col("_s._kind"))
        kept = lambda c: F.when(F.col("_go"), c)
        _, at, nodes, kinds = _extended()
        rows = rows.select("source", kept(at).otherwise(F.col("at")).alias("at"), kept(nodes).otherwise(F.col("nodes")).alias("nodes"), kept(kinds).otherwise(F.col("kinds")).alias("kinds"), F.col("_go").alias("_on"))
    out = rows.where(F.size("kinds") > 0)
    return out if targets is None else out.join(F.broadcast(targets.select(F.col("node").alias("at"))), "at", "left_semi")


def search(edges: DataFrame, sources: DataFrame, targets: DataFrame | None, direction: str = "incoming", max_len: int = 3, per_pair: int | None = None, limit: int | None = None, kinds: tuple[str, ...] | None = None, small: bool = False) -> DataFrame:
    """Simple paths of 1 to ``max_len`` hops: (``source``, ``target``, ``hops``, ``nodes``, ``kinds``).

    ``edges`` has ``child``, ``parent`` and ``kind``; ``sources`` and ``targets``
    have ``node``.  ``incoming`` goes from parent to child, ``outgoing`` from child
    to parent.  Without ``targets`` every end counts.  ``per_pair`` keeps the
    shortest paths of each pair (ties by nodes), ``limit`` keeps the shortest of all.
    ``small`` is for edges that are known to fit in a broadcast: one statement, and nothing written.
    """
    if direction not in ("incoming", "outgoing"):
        raise ValueError("direction must be incoming or outgoing")
    if max_len < 1:
        raise ValueError("max_len must be 1 or more")
    if kinds:
        edges = edges.where(F.col("kind").isin(*kinds))
    here, there = ("parent", "child") if direction == "incoming" else ("child", "parent")
    steps = edges.select(F.col(here).alias("_from"), F.col(there).alias("_to"), F.col("kind").alias("_kind"))
    if small:
        out = _at_once(steps, sources, targets, max_len)
    else:
        scratch = Scratch(edges.sparkSession, "paths")
        useful = _useful(steps, sources, targets, max_len, scratch)
        front, found, made = _start(sources), [], 0
        for h, step in enumerate(useful, 1):
            ahead = front.join(step, F.col("at") == F.col("_from")).where(~F.array_contains("nodes", F.col("_to"))).select(*_extended(), "_hit", "_on")
            if h == len(useful):  # read once
                found.append(ahead.where("_hit").drop("_hit", "_on"))
                break
            level = scratch.table(ahead, f"front-{h}")
            found.append(level.where("_hit").drop("_hit", "_on"))
            front = level.where("_on").drop("_hit", "_on")
            if front.isEmpty():
                break
            if limit and not per_pair and h < max_len:  # paths of more hops come after all of these
                made += found[-1].count()
                if made >= limit:
                    break
        out = reduce(DataFrame.unionByName, found) if found else _start(sources).where("false")
    out = out.select("source", F.col("at").alias("target"), F.size("kinds").alias("hops"), "nodes", "kinds")
    if per_pair:
        order = Window.partitionBy("source", "target").orderBy("hops", "nodes", "kinds")
        out = out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_pair).drop("_n")
    return out.orderBy("hops", "nodes", "kinds").limit(limit) if limit else out


def deepest(paths: DataFrame) -> DataFrame:
    """A row for each source: its path of most hops, the least nodes winning ties."""
    best = F.min_by(F.struct("target", "hops", "nodes"), F.struct(-F.col("hops"), F.col("nodes")))
    return paths.groupBy("source").agg(best.alias("p")).select("source", "p.target", "p.hops", "p.nodes")


def unresolved(paths: DataFrame, terminal: DataFrame) -> DataFrame:
    """The deepest paths that end in a node that isn't terminal; ``terminal`` has ``node`` and ``terminal``."""
    return deepest(paths).join(terminal.select(F.col("node").alias("target"), "terminal"), "target").where("not terminal").select("source", F.col("target").alias("frontier"), "hops")


def is_witness(nodes: Column, edges: Column) -> Column:
    """Whether arrays of node structs (``id``, ``generation``, ``terminal``) and edge structs (``child``, ``parent``) are one incoming path.

    One node more than edges; each edge joins its neighbours, child after
    parent; generations rise; the first node is terminal.
    """
    idx = F.sequence(F.lit(1), F.size(edges))
    joined = F.forall(
        idx,
        lambda i: (F.element_at(edges, i)["parent"] == F.element_at(nodes, i)["id"]) & (F.element_at(edges, i)["child"] == F.element_at(nodes, i + 1)["id"]) & (F.element_at(nodes, i)["generation"] < F.element_at(nodes, i + 1)["generation"]),
    )
    shape = (F.size(edges) >= 1) & (F.size(nodes) == F.size(edges) + 1)
    return F.coalesce(F.when(shape, joined & F.element_at(nodes, 1)["terminal"]).otherwise(False), F.lit(False))
