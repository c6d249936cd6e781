from pyspark.sql import functions as F

from lineaspark.streaming import ledger

SCHEMA = "event bigint, at timestamp, request_id string, action_id string, fingerprint string"


def run(spark, df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def source(spark, tmp_path):
    rows = [(1, 10, "r1", "a", "f"), (2, 11, "r2", "a", "f"), (3, 12, "r1", "a", "f"), (4, 13, "r1", "a", "g"), (5, 14, "r5", "b", "f"), (6, 15, "r5", "c", "f")]
    df = spark.createDataFrame(rows, "event bigint, s bigint, request_id string, action_id string, fingerprint string").withColumn("at", F.timestamp_seconds("s")).drop("s")
    df.select("event", "at", "request_id", "action_id", "fingerprint").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def test_actions_are_reserved_once(spark, tmp_path):
    got = {r.event: r.outcome for r in run(spark, ledger.decisions(source(spark, tmp_path)), "decided")}
    assert got == {1: "RESERVED", 2: "ACTION_ID_CONFLICT", 3: "REQUEST_REPLAYED", 4: "REQUEST_ID_CONFLICT", 5: "RESERVED", 6: "RESERVED"}


def test_first_requests(spark, tmp_path):
    assert {r.request_id for r in run(spark, ledger.first_requests(source(spark, tmp_path)), "firsts")} == {"r1", "r2", "r5"}


def test_an_exact_ledger_never_forgets(spark, tmp_path):
    rows = [(1, 1, "r1", "a", "f"), (2, 2, "r2", "b", "f"), (3, 3, "r2", "c", "g"), (4, 10**9, "r1", "a", "f"), (5, 10**9, "r5", "c", "f"), (6, 10**9, "r6", "b", "f"), (7, 10**9, "r7", "d", "f")]
    kind = "event bigint, arrived_at bigint, request_id string, action_id string, fingerprint string"
    for k, some in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(some, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        q = ledger.exact(stream, str(tmp_path / "ledger"), capacity=3).start()
        q.processAllAvailable()
        q.stop()
    got = {r.event: r.outcome for r in spark.read.parquet(str(tmp_path / "ledger" / "outcomes")).collect()}
    assert got == {1: "RESERVED", 2: "RESERVED", 3: "REQUEST_ID_CONFLICT", 4: "REQUEST_REPLAYED", 5: "RESERVED", 6: "ACTION_ID_CONFLICT", 7: "ACTION_LEDGER_FULL"}


def test_outcomes_by_window(spark, tmp_path):
    decided = source(spark, tmp_path).withColumn("outcome", F.lit("RESERVED"))
    q = ledger.windowed_outcomes(decided).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.table("windows").collect()) == 6
