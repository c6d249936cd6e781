"""Legal input that is rare: great counts, halves of surrogate pairs, null ids, long chains."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lineaspark.config import SENDING, LineageConfig
from lineaspark.functions import surrogates
from lineaspark.operators import closure, decide, ledger, writes
from lineaspark.sources.snapshots import Scratch

from .test_lineage import BASE, REQUESTS, plain_ledger


def layered(spark, layers, width):
    nodes = [(f"{g}/{k}", g, g == 0) for g in range(layers) for k in range(width)]
    edges = [(f"{g}/{k}", f"{g - 1}/{j}", g, g - 1) for g in range(1, layers) for k in range(width) for j in range(width)]
    return spark.createDataFrame(nodes, "artifact_id string, generation int, terminal boolean"), spark.createDataFrame(edges, "child string, parent string, child_generation int, parent_generation int")


def test_path_counts_beyond_a_long(spark):
    got = {r.artifact_id: (r.value, r.digits) for r in closure.path_counts(*layered(spark, 23, 8)).collect()}
    assert got["22/3"] == (None, str(8**22)) and got["20/0"] == (8**20, str(8**20)) and got["0/0"] == (1, "1")


def test_carries(spark):
    rng = random.Random(3)
    numbers = [0, 1, 10**9 - 1, 10**9, 10**117 - 1, 10**117, *(rng.randrange(10**rng.randrange(1, 117)) for _ in range(30))]
    split = lambda n: [n // 10 ** (9 * k) % 10**9 for k in range(13)] + [n // 10**117]
    times = 8_999_999_999  # as many parents
    rows = [(str(n * f), [x * f for x in split(n)]) for n in numbers for f in (1, 64, times)]
    got = spark.createDataFrame(rows, "n string, sums array<bigint>").select("n", closure._carried(F.col("sums")).alias("x")).collect()
    for r in got:
        n = int(r.n)
        assert r.x[:13] == split(n)[:13] and r.x[13] == int(n >= 10**117)


RAWS = [
    r'"\ud800"', r'"\uD800"', r'"\udc00"', '"?"', r'"\ufffd"', r'"\ud83d\ude00"', '"😀"', r'"\\ud800"', r'"\\\ud800"', r'"\ud800\ud800"', r'"\ud83d\ud83d\ude00\ude00"',
    r'"\udbff\\udc00"', '"\ufdd0"', r'"\ufdd0"', '"\ufdd0s1234"', '"\ufdd0e"', r'"\uFDD0s\ud801x"', r'"a\ud8ABc"', '"plain"', r'"\\\\ud800"', '"' + "\\\\" * 3000 + r"\udfff" + '"', '"' + r"\ud800" * 600 + '"',
]


def canonical(text):
    """As a well-formed JSON writer has it: halves escaped, in lower case."""
    return "".join(f"\\u{ord(c):04x}" if 0xD800 <= ord(c) < 0xE000 else c for c in json.dumps(json.loads(text), ensure_ascii=False))


def test_halves_of_pairs_stay_apart(spark):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(RAWS)], "k int, raw string")
    v = F.try_variant_get(F.try_parse_json(surrogates.guarded(F.col("raw"))), "$", "string")
    got = df.select("k", surrogates.escaped(F.to_json(F.array(v))).alias("text"), surrogates.shown(v).alias("shown")).collect()
    for r in got:
        want = json.loads(RAWS[r.k])
        assert r.text == f"[{canonical(RAWS[r.k])}]"
        assert r.shown == "".join("\ufffd" if 0xD800 <= ord(c) < 0xE000 else c for c in want)


@pytest.mark.parametrize("kinds", [(SENDING,), (SENDING, "note")])
def test_payloads_that_differ_have_digests_that_differ(spark, kinds):
    """One such payload spoils neither its own digest nor the rest of its batch, with the usual action and with others."""
    rows = []
    for k, r in enumerate(RAWS):
        text = json.dumps(BASE | {"request_id": f"r-{k}", "action_type": kinds[-1]}).replace('"Approved action payload"', r)
        rows.append((k, text if kinds[-1] == SENDING else text.replace('"destination": "internal:alerts"', '"deeper": {"x": ' + r + "}")))
    got = decide.validate_intents(spark.createDataFrame(rows, "k int, raw string").repartition(1), LineageConfig(action_types=kinds)).collect()
    for r in got:
        p = json.loads(rows[r.k][1])["parameters"]
        size = len(p["payload"].encode("utf-8", "surrogatepass"))
        inner = ",".join(f'"{f}":' + (canonical(json.dumps(p[f])) if isinstance(p[f], str) else '{"x":' + canonical(json.dumps(p[f]["x"])) + "}") for f in sorted(p))
        valid = len(f"{{{inner}}}".encode()) <= 8192 and (kinds[-1] != SENDING or size <= 4096)
        assert (r.detail == "ACTION_INTENT_VALID") == valid, (r.k, r.detail)
        if valid:
            said = f'{{"action_type":"{kinds[-1]}","parameters":{{{inner}}},"subject_id":"{BASE["subject_id"]}"}}'
            assert r.semantic_digest == hashlib.sha256(said.encode()).hexdigest()
    digests = {r.k: r.semantic_digest for r in got if r.semantic_digest}
    same = [{0, 1}, {5, 6}, {12, 13}]
    for a in digests:
        assert {b for b in digests if digests[b] == digests[a]} == next((s for s in same if a in s), {a})


def test_contents_read_halves_as_one_character(spark):
    df = spark.createDataFrame([(json.dumps({"content": c}),) for c in ("\ud800", "\ufffd", "?")], "raw string")
    assert [r[0] for r in df.select(writes.producer_output(F.col("raw"))).collect()] == [None] * 3
    parsed = writes.parse_sources(spark.createDataFrame([(json.dumps({"id": "a", "content": c}),) for c in ("x\udc00", "x\ufffd", "x?")], "raw string"))
    assert sorted(r.content for r in parsed.collect()) == ["x?", "x\ufffd", "x\ufffd"]


def test_null_ids_are_ids(spark):
    rows = [(1, 1, "r1", None, "f"), (2, 2, "r2", None, "f"), (3, 3, None, "a", "f"), (4, 4, None, "b", "f"), (5, 5, "r5", "b", "f"), (6, 6, None, "a", "f"), (7, 7, "r1", None, "f")]
    df = spark.createDataFrame(rows, REQUESTS)
    for fold in (0, 100):
        assert {r.event: r.outcome for r in ledger.settle(df, fold=fold).collect()} == plain_ledger(rows)
    held = [(None, "z", "f", "ok"), ("r5", None, "f", "timeout")]
    got = ledger.settle(df, held=spark.createDataFrame(held, "request_id string, action_id string, fingerprint string, adapter string")).collect()
    assert {r.event: r.outcome for r in got} == plain_ledger(rows, held=held)
    firsts = [(k, t, f"u{k}", a, f) for k, t, _, a, f in rows]
    assert dict(map(tuple, ledger.first_wins(spark.createDataFrame(firsts, REQUESTS)).collect())) == plain_ledger(firsts)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n, names, table = 5000, [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: names.append(name) or table(self, df, name))
    chain = [(k, k, f"r{k // 2}", f"a{(k + 1) // 2}", "f") for k in range(n)]
    rng = random.Random(2)
    mixed = [(n + k, rng.randrange(n), f"q{rng.randrange(400)}", f"b{rng.randrange(400)}", "f") for k in range(1500)]
    got = {r.event: r.outcome for r in ledger.settle(spark.createDataFrame(chain + mixed, REQUESTS), fold=0).collect()}
    assert got == plain_ledger(chain + mixed)
    assert sum(x.startswith("open-") for x in names) <= 12 and sum(x.startswith("chain-0-") for x in names) <= 16
