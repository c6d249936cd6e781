import os

import pytest

from lineaspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_oracle(spark, tables, name):
    got, want = catalogue.QUERIES[name](spark, SF).toArrow(), tables.execute(catalogue.SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names) and want.num_rows
    cols = sorted(got.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t.column(c).to_pylist() for c in cols), strict=True)))
    assert rows(got) == rows(want)


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_helper_replaces_another():
    """Two functions of one name in the catalogue: the second takes the place of the first, and queries that mean the first fail."""
    import ast
    from collections import Counter

    with open(catalogue.__file__) as f:
        made = Counter(x.name for x in ast.parse(f.read()).body if isinstance(x, ast.FunctionDef))
    assert not [name for name, n in made.items() if n > 1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_walks_fold_no_validity(spark, monkeypatch):
    def folded(*_):
        raise AssertionError("a walk reads no validity")

    monkeypatch.setattr(catalogue.closure, "valid_closures", folded)
    monkeypatch.setattr(catalogue.closure, "revalidated", folded)
    assert catalogue.spoilt_nodes(spark, f"{SF}/").where("not node_ok").count() == 2  # the folder by another name: nothing is stored for it yet
