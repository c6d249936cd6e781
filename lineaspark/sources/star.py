"""The star schema read as a lineage graph, and the other tables as intents, contents and chains.

Regions and parts are sources; nations derive from regions, suppliers and
customers from nations, orders from customers, and line items from their order,
parts and suppliers.  A line item key may repeat: its rows are one artifact
with the union of their parents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import read


def _id(kind: str, *keys: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.concat_ws("-", *(F.col(k).cast("string") for k in keys)))


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp's own calendar fields, whatever the session's time zone."""
    day = F.unix_date(ts.cast("date")) * F.lit(86_400_000).cast("bigint")
    return day + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("bigint")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``artifact_id``, ``role``, ``generation``, ``lineage_kind``, ``content``, ``trust_state``, ``authority_id``)."""

    def part(table: str, kind: str, keys: tuple[str, ...], role: str, gen: int, lineage: str, content: Column, trust: Column, authority: Column, rows: DataFrame | None = None) -> DataFrame:
        return (read(spark, sf_dir, table) if rows is None else rows).select(
            _id(kind, *keys).alias("artifact_id"), F.lit(role).alias("role"), F.lit(gen).alias("generation"), F.lit(lineage).alias("lineage_kind"),
            content.alias("content"), trust.alias("trust_state"), authority.alias("authority_id"),
        )

    derived, writer = F.lit("derived"), F.lit("lineage-writer-v1")
    odd = F.col("p_size") % 25 == 0
    out = [
        part("region", "region", ("r_regionkey",), "source", 0, "source", F.col("r_name"), F.lit("trusted_source"), F.lit("registry")),
        part("part", "part", ("p_partkey",), "source", 0, "source", F.col("p_name"), F.when(odd, "untrusted_source").otherwise("trusted_source"), F.when(F.col("p_size") % 20 == 1, "vendor").otherwise("registry")),
        part("nation", "nation", ("n_nationkey",), "claim", 1, "assert", F.col("n_name"), derived, writer),
        part("supplier", "supplier", ("s_suppkey",), "summary", 2, "summarize", F.col("s_name"), derived, writer),
        part("customer", "customer", ("c_custkey",), "summary", 2, "summarize", F.col("c_name"), derived, writer),
        part("orders", "order", ("o_orderkey",), "claim", 3, "support", F.concat_ws("|", "o_orderstatus", "o_orderpriority"), derived, writer),
    ]
    # a line's repeats are dropped by its keys, a third of the size of the texts made of them; where one key is null the text is the other's
    keys = read(spark, sf_dir, "lineitem").select(F.coalesce("l_orderkey", F.col("l_linenumber").cast("bigint")).alias("l_orderkey"), F.when(F.col("l_orderkey").isNotNull(), F.col("l_linenumber")).alias("l_linenumber")).distinct()
    lines = part("lineitem", "lineitem", ("l_orderkey", "l_linenumber"), "action_argument", 4, "require", F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")), derived, writer, keys)
    return reduce(DataFrame.unionByName, [*out, lines])


def derivation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``child``, ``parents``) as observed, a row for each row of a table."""
    one = lambda table, kind, key, of, parent: read(spark, sf_dir, table).select(_id(kind, key).alias("child"), F.array(_id(of, parent)).alias("parents"))
    three = F.array(_id("order", "l_orderkey"), _id("part", "l_partkey"), _id("supplier", "l_suppkey"))
    lists = [
        one("nation", "nation", "n_nationkey", "region", "n_regionkey"), one("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
        one("customer", "customer", "c_custkey", "nation", "c_nationkey"), one("orders", "order", "o_orderkey", "customer", "o_custkey"),
        read(spark, sf_dir, "lineitem").select(_id("lineitem", "l_orderkey", "l_linenumber").alias("child"), three.alias("parents")),
    ]
    return reduce(DataFrame.unionByName, lists)


def derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``child``, ``parent``) as observed, repeated pairs included."""
    return derivation_lists(spark, sf_dir).select("child", F.explode("parents").alias("parent"))


def chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as linear chains: (nodes of ``artifact_id``, ``generation``), (``child``, ``parent``)."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn")
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("first"))
    turns = turns.join(first, "conv_id")
    name = lambda c: F.concat(F.lit("turn/"), F.col("conv_id").cast("string"), F.lit("-"), c.cast("string"))
    made = turns.select(name(F.col("turn")).alias("artifact_id"), (F.col("turn") - F.col("first")).cast("int").alias("generation"))
    links = turns.where("turn > first").select(name(F.col("turn")).alias("child"), name(F.col("turn") - 1).alias("parent"))
    return made, links


def _event_fields(spark: SparkSession, sf_dir: str, again: bool) -> DataFrame:
    """Events as ``event``, its number ``n``, ``ms`` and ``arrived_at``, and whether it is sent again with another payload.

    With ``again`` some events are sent twice: under the same request id, either as they were or changed.
    """
    e = read(spark, sf_dir, "events")
    e = e.select(F.col("event_id").alias("n"), millis(F.col("ts")).alias("ms"), "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    sent = [e.withColumn("event", F.col("n")).withColumn("arrived_at", F.col("ms")).withColumn("changed", F.lit(False))]
    if again:
        late = e.withColumn("arrived_at", F.col("ms") + 1)
        sent.append(late.where("n % 73 = 26").withColumn("event", F.col("n") * -2).withColumn("changed", F.lit(False)))
        sent.append(late.where("n % 79 = 27").withColumn("event", F.col("n") * -2 - 1).withColumn("changed", F.lit(True)))
    return reduce(DataFrame.unionByName, sent)


def _payload() -> dict[str, Column]:
    """What an event's action is about, by its number."""
    n = F.col("n")
    return {
        "action_type": F.when(n % 29 == 9, "erase").otherwise("send_message"),
        "data_class": F.when(n % 13 == 5, "restricted").when(n % 17 == 6, "secret").otherwise("internal"),
        "destination": F.when(n % 11 == 3, "external:mail").otherwise("internal:alerts"),
        "payload": F.when(n % 19 == 7, "").otherwise(F.concat(F.lit("event "), F.col("event_type"))),
        "subject_id": F.concat(F.lit("user-"), F.col("user_id").cast("string")),
    }


def intents(spark: SparkSession, sf_dir: str, again: bool = False) -> DataFrame:
    """Raw action intents as JSON text (``event_id``, ``n``, ``raw``, ``arrived_at``), a row for each event; many are malformed on purpose.

    The event's number decides which fault, if any, so every rule has rows:
    fields that are missing, unknown, repeated, too long or of another JSON type.
    """
    n = F.col("n")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    about = _payload()
    action = F.concat_ws(":", F.lit("a"), F.col("user_id"), F.col("event_type"), F.col("k"))
    payload = F.when(n % 101 == 33, F.repeat(F.lit("p"), 4097)).otherwise(F.concat(about["payload"], F.when(F.col("changed"), "!").otherwise("")))
    destination = text(about["destination"])
    fields = F.concat(
        F.lit('{"action_id":'), F.when(n % 83 == 30, F.lit("7")).otherwise(text(F.when(n % 23 == 8, "not valid").otherwise(action))),
        F.lit(',"subject_id":'), F.when(n % 109 == 36, F.lit("null")).otherwise(text(about["subject_id"])),
        F.lit(',"action_type":'), text(about["action_type"]),
        F.lit(',"parameters":{"data_class":'), text(about["data_class"]),
        F.lit(',"destination":'), F.when(n % 97 == 32, F.concat(F.lit('{"destination":'), destination, F.lit("}"))).otherwise(destination),
        F.lit(',"payload":'), text(payload), F.when(n % 103 == 34, F.lit(',"x":1}')).otherwise(F.lit("}")),
        F.when(n % 31 == 10, F.lit("")).otherwise(F.concat(F.lit(',"request_id":'), text(F.concat(F.lit("r-"), n.cast("string"))))),
        F.lit(',"requested_at":'), F.when(n % 89 == 31, text(F.col("ms").cast("string"))).when(n % 107 == 35, F.lit("1000.5")).otherwise(F.col("ms").cast("string")),
        F.lit(',"provenance_artifact_id":'), text(F.concat(F.lit("action/"), n.cast("string"))),
        F.when(n % 37 == 11, F.lit(',"trusted":true')).otherwise(F.lit("")), F.when((n % 127 == 38) & (n % 31 != 10), F.lit(',"request_id":"r"')).otherwise(F.lit("")), F.lit("}"),
    )
    raw = F.when(n % 41 == 12, F.lit("[1]")).when(n % 113 == 37, F.lit('"text"')).otherwise(fields)
    return _event_fields(spark, sf_dir, again).select(F.col("event").alias("event_id"), "n", raw.alias("raw"), "arrived_at")


def actions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Action arguments of events as (nodes, lists of derivations), to add to those of the star without its line items.

    An action's content is the canonical text that its intent's digest covers,
    and it derives from a customer and a part; by the event's number it is not
    stored, has another content, one source only, a longer ancestry or more parts.
    """
    keys = {t: read(spark, sf_dir, t).agg(F.coalesce(F.max(c) + 1, F.lit(1))).first()[0] for t, c in (("customer", "c_custkey"), ("part", "p_partkey"), ("orders", "o_orderkey"))}
    n, about = F.col("n"), _payload()
    name = F.concat(F.lit("action/"), n.cast("string"))
    parts = [F.lit(x) for x in ('{"action_type":"', '","parameters":{"data_class":"', '","destination":"', '","payload":"', '"},"subject_id":"', '"}')]
    whole = F.concat(*(x for pair in zip(parts, [about[f] for f in ("action_type", "data_class", "destination", "payload", "subject_id")], strict=False) for x in pair), parts[-1])
    e = _event_fields(spark, sf_dir, False).where("n % 43 <> 14")
    made = e.select(
        name.alias("artifact_id"), F.lit("action_argument").alias("role"), F.lit(4).alias("generation"), F.lit("require").alias("lineage_kind"),
        F.when(n % 47 == 15, "other").otherwise(whole).alias("content"), F.lit("derived").alias("trust_state"), F.lit("lineage-writer-v1").alias("authority_id"),
    )
    at = lambda kind, table, c: F.concat(F.lit(kind), F.pmod(c, F.lit(keys[table])).cast("string"))
    some = F.when(n % 61 == 18, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.when(n % 59 == 17, 5).otherwise(0)))
    parents = F.concat(
        F.array(at("customer/", "customer", n)), F.transform(some, lambda k: at("part/", "part", n + k)),
        F.when(n % 53 == 16, F.array(at("order/", "orders", n))).otherwise(F.array().cast("array<string>")),
    )
    return made, e.select(name.alias("child"), parents.alias("parents"))
