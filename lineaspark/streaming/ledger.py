"""The replay ledger over a stream of requests.

Batch rules live in ``operators.ledger``.  :func:`exact` settles each batch of a
stream against all reservations that were ever made, which it keeps as a table,
and forgets none.  :func:`decisions` keeps them as state for as long as the
watermark holds an id, which bounds the state: a request that repeats an id
later than that is reserved anew, so it is for ids that don't come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shipping import ship
from ..sources.snapshots import Scratch

KEEP_MS = 600_000
OUT = "event bigint, action_id string, outcome string"


def first_requests(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests (``at`` timestamp, ``request_id``, …) without those whose ``request_id`` came before, within the watermark."""
    return requests.withWatermark("at", late).dropDuplicatesWithinWatermark(["request_id"])


def decisions(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(``event``, ``action_id``, ``outcome``) as requests arrive: the first of each ``action_id`` is RESERVED, later ones conflict or are replays.

    Keyed by ``action_id``; the state is the reserving request's id and
    fingerprint, and goes ``KEEP_MS`` after the last request, by the watermark.  Within a batch requests
    count in order of ``at``, then ``event``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "event"])
        out = []
        for r in rows.itertuples():
            if held is None:
                held = (r.request_id, r.fingerprint)
                out.append("RESERVED")
            else:
                out.append(("REQUEST_REPLAYED" if held[1] == r.fingerprint else "REQUEST_ID_CONFLICT") if held[0] == r.request_id else "ACTION_ID_CONFLICT")
        state.update(held)
        state.setTimeoutTimestamp(int(rows["at"].max().timestamp() * 1000) + KEEP_MS)
        yield pd.DataFrame({"event": rows["event"], "action_id": key[0], "outcome": out})

    ship(requests.sparkSession)
    keyed = requests.select("event", "at", "request_id", "action_id", "fingerprint").withWatermark("at", late).groupBy("action_id")
    return keyed.applyInPandasWithState(step, OUT, "request_id string, fingerprint string", "append", GroupStateTimeout.EventTimeTimeout)


def exact(requests: DataFrame, path: str, capacity: int | None = None) -> DataStreamWriter:
    """A query that settles requests (as ``operators.ledger.settle`` takes them), batch by batch, in tables below ``path``.

    ``outcomes`` has the outcome of every request and ``reservations`` all that
    stand, each in a folder a batch, so a batch that is run again replaces what
    it wrote.  Within a batch requests count in order of arrival; a batch that
    comes later counts as later.
    """
    from ..operators import ledger

    def settle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = "request_id string, action_id string, fingerprint string, adapter string"
        held = None
        if number:
            held = spark.read.schema(f"{kind}, batch bigint").parquet(f"{path}/reservations").where(F.col("batch") < number).drop("batch")
        rows = Scratch(spark, "stream").table(batch, "batch")
        settled = Scratch(spark, "stream").table(ledger.settle(rows, capacity, held), "settled")
        settled.write.mode("overwrite").parquet(f"{path}/outcomes/batch={number}")
        new = rows.drop("adapter").join(settled.where("outcome = 'RESERVED'").select("event", "adapter"), "event")
        new.select("request_id", "action_id", "fingerprint", "adapter").write.mode("overwrite").parquet(f"{path}/reservations/batch={number}")

    return requests.writeStream.foreachBatch(settle).option("checkpointLocation", f"{path}/checkpoint")


def windowed_outcomes(decided: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts of outcomes by window of arrival; late data is taken until the watermark passes."""
    return decided.withWatermark("at", late).groupBy(F.window("at", width), "outcome").agg(F.count("*").alias("n"))
