import os
import shutil

import pytest
from pyspark.sql import types as T

from lineaspark.plans import catalogue
from lineaspark.sources.versions import StaleVersion, Versions, state_of

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("k", T.LongType())])


def rows(store, version=None):
    return sorted(r.k for r in store.read("t", SCHEMA, version).collect())


def test_readers_keep_their_version(spark, tmp_path):
    store, some = Versions(spark, f"file://{tmp_path}/s"), lambda *k: {"t": spark.createDataFrame([(x,) for x in k], "k bigint")}
    with pytest.raises(ValueError):
        store.manifest()
    assert store.commit(some(1, 2), "a") == 1
    assert store.commit(some(3), "b", base=1) == 2
    assert store.commit(some(9), "c") == 3
    assert [rows(store, v) for v in (1, 2, 3, None)] == [[1, 2], [1, 2, 3], [9], [9]]
    assert (store.find("a"), store.find("b"), store.find("x")) == (1, 2, None)
    with pytest.raises(StaleVersion):
        store.commit(some(4), base=2)
    assert store.list() == [1, 2, 3]
    with pytest.raises(ValueError):
        store.read("t", SCHEMA, 7)


def test_a_place_is_taken_once(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/s")
    empty = {"version": 1, "base": None, "state": "", "tables": {}}
    assert store._publish(empty | {"state": "first"}) and not store._publish(empty | {"state": "second"})
    assert store.manifest(1)["state"] == "first"


def test_changed_files_are_noticed(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/s")
    store.commit({"t": spark.range(3).withColumnRenamed("id", "k").coalesce(1)})
    (folder,) = (tmp_path / "s" / "data").iterdir()
    (part,) = (folder / "t").glob("part-*")
    part.rename(part.with_name("part-other.parquet"))
    with pytest.raises(ValueError):
        rows(store)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_answers_follow_a_table_that_changes(spark, tmp_path):
    sf = str(tmp_path / "sf")
    shutil.copytree(SF, sf)
    os.chmod(sf, 0o755)
    before = catalogue.hmac_tags(spark, sf)
    n = before.count()
    parts = spark.read.parquet(f"{SF}/part.parquet")
    gone = parts.count() - 10
    os.chmod(f"{sf}/part.parquet", 0o644)
    parts.orderBy("p_partkey").limit(10).toPandas().to_parquet(f"{sf}/part.parquet")
    spark.catalog.refreshByPath(f"{sf}/part.parquet")
    assert gone > 0 and catalogue.hmac_tags(spark, sf).count() == n - gone == catalogue.derived_ids(spark, sf).count()
    assert catalogue.signed(spark, sf, version=1)[0].count() == n
    assert catalogue.snapshots(spark, sf, "star").list() == [1, 2]


def test_the_state_is_of_names_sizes_and_times(spark, tmp_path):
    (tmp_path / "t").mkdir()
    states = set()
    for name, text, when in (("a", "x", 1), ("a", "xy", 1), ("a", "xy", 2), ("b", "xy", 2), ("_b", "xy", 2)):
        (tmp_path / "t" / name).write_text(text)
        os.utime(tmp_path / "t" / name, (when, when))
        states.add(state_of(spark, f"file://{tmp_path}/t"))
    assert len(states) == 4
