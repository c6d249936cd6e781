import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lineaspark.llm import hilbert

SCHEMA = "doc_id bigint, text string, lang string, source string, shard string, rank int"


def test_curve_visits_each_cell_once_by_single_steps():
    for dims, bits in ((2, 1), (2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        at = hilbert.hilbert_index(cells, bits)
        assert sorted(at) == list(range(len(cells)))
        path = cells[np.argsort(at)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_rows_are_dealt_evenly(spark):
    rng = random.Random(1)
    rows = [(k, "x" * rng.randrange(500), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", None]), "s", 1) for k in range(203)]
    rows += [(300, None, None, None, "", 0), (301, "", "", "", "", 0), (4, rows[0][1], "en", "a", "", 0), (None, "é😀", "en", "a", "", 0), (302, "y" * 90_000, "en", "b", "", 0)]
    got = hilbert.assign(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert len(got) == len(rows)
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)


def test_few_rows_none_and_missing_columns(spark):
    assert hilbert.assign(spark.createDataFrame([], SCHEMA)).collect() == []
    three = hilbert.assign(spark.createDataFrame([(k, "t") for k in range(3)], "doc_id bigint, text string")).collect()
    assert len({r.shard for r in three}) == 3 and {r.slot for r in three} == {0}


def test_written_shards_hold_all_rows(spark, tmp_path):
    rows = [(k, "x" * k, "en", "a", "s", k) for k in range(40)]
    hilbert.write(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(40))
    assert {r["count"] for r in back.groupBy("shard_no").count().collect()} == {5}
    odd = [(1, "a", "en", "a", "s", 0), (1, "a", "en", "a", "s", 0), (1, "b", "fr", "a", "s", 0), (None, "c", None, None, "s", 0), (None, None, "en", "b", "s", 0), (2, "d", "en", "a", "s", 0)]
    hilbert.write(spark.createDataFrame(odd, SCHEMA), str(tmp_path / "odd"), shards=3)
    back = spark.read.parquet(str(tmp_path / "odd")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in back) == sorted((str(r[0]), str(r[1])) for r in odd) and {r.shard_no for r in back} == {0, 1, 2}


def test_files_prune_in_several_dimensions(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, "x" * rng.randrange(2000), rng.choice(["en", "fr", "de", "es"]), f"s{rng.randrange(6)}", "s", 0) for k in range(2000)]
    hilbert.write(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "out"), shards=32)
    files = spark.read.parquet(str(tmp_path / "out")).groupBy("shard_no").agg(F.min(F.length("text")).alias("a"), F.max(F.length("text")).alias("z"), F.collect_set("lang").alias("langs"), F.collect_set("source").alias("sources")).collect()
    some = lambda f: sum(map(f, files)) / len(files)
    assert some(lambda r: r.a <= 100) < 0.6 and some(lambda r: "en" in r.langs) < 0.7 and some(lambda r: "s1" in r.sources) < 0.7
