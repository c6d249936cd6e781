import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from lineaspark.llm import vector_codes as codes
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, _label string"


def nearest(x, entries):
    return min(((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(entries)), default=None)


def plain(rows, length):
    """((vec_id, label, code, error, label_error), digest) of rows of ``length`` components, by plain loops."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (length - len(v)), l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    w = length // 16
    cut = [[r[1][p * w : (p + 1) * w] for p in range(16)] for r in kept]
    books = [[list(c[p]) for c in cut[:64]] for p in range(16)]
    for _ in range(2):
        for p in range(16):
            got = {}
            for c in cut:
                got.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for e, xs in got.items():
                books[p][e] = [sum(x) // len(xs) for x in zip(*xs)]
    found = [[nearest(c[p], books[p]) for p in range(16)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for r, e in zip(kept, errors):
        sums[r[2]] = sums.get(r[2], 0) + e
    out = [(r[0], r[2], "".join(f"{k:02x}" for _, k in f), e, sums[r[2]]) for r, f, e in zip(kept, found, errors)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def rows_of(seed=4, n=150):
    rng = np.random.default_rng(seed)
    made = [(k * 3, [float(x) for x in rng.normal(0, 0.2, 32).astype(np.float32)], int(k % 4) if k % 7 else None) for k in range(n)]
    nan, inf = float("nan"), float("inf")
    made += [(1000, None, 1), (1001, [nan] * 32, 1), (1002, [0.5] * 31 + [-inf], 1), (1003, [0.5] * 31 + [None], 1)]
    made += [(2, [-0.001] * 32, 9), (2, [-0.001] * 32, 9), (None, [0.25] * 32, None), (-5, [], 2), (7, [1.0] * 20, 2)]
    return made


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("parts", [1, 6])
def test_against_plain_loops(spark, parts):
    rows = rows_of()
    got, books = codes.compress(frame(spark, rows, parts))
    want, digest = plain(rows, 32)
    key = lambda r: repr(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert books.digest() == digest


def test_labels_by_shuffle(spark):
    rows = rows_of(n=40)
    a, b = (sorted(map(repr, codes.compress(frame(spark, rows), broadcast_rows=n)[0].collect())) for n in (0, 10))
    assert a == b


def test_few_none_and_empty(spark):
    assert codes.compress(frame(spark, []))[0].collect() == []
    assert codes.compress(frame(spark, [(1, None, 2), (2, [float("nan")], 2)]))[0].collect() == []
    got = codes.compress(frame(spark, [(1, [], 2), (2, [], None)]))[0].collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == [(1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0)]
    (row,) = codes.compress(frame(spark, [(1, [0.5] * 16, 2)]))[0].collect()
    assert (row.code, row.error) == ("00" * 16, 0)


def test_a_length_that_parts_do_not_divide_and_great_components(spark):
    got, books = codes.compress(frame(spark, [(1, [1e30] * 17, 1), (2, [-1e30] * 17, 1), (3, [0.0] * 3, 1)]))
    assert books.entries.shape == (16, 3, 2) and got.where("error < 0 or label_error < 0").count() == 0 and got.count() == 3
    assert books.entries.max() == codes.limit(32)


@pytest.mark.parametrize("bits", [1, 3, 4, 6])
def test_bounds_hold_and_rule_out_most(bits):
    rng = np.random.default_rng(bits)
    entries, x = rng.integers(-90, 90, (64, 4)), rng.integers(-120, 120, (500, 4))
    cells = codes.Cells(entries, bits)
    low, high = cells.bounds(x)
    exact = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (low <= exact).all() and (exact <= high).all()
    candidates = (low <= high.min(axis=1, keepdims=True)).sum()
    assert candidates < x.shape[0] * 64 * {1: 1, 3: 0.5, 4: 0.25, 6: 0.1}[bits]
    entry, distance = cells.nearest(x)
    assert (entry == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_ties_go_to_the_lower_entry():
    cells = codes.Cells(np.array([[5, 5], [0, 0], [0, 0], [10, 10]]))
    assert [a.tolist() for a in cells.nearest(np.array([[0, 0], [5, 5], [1, 1]]))] == [[1, 0, 1], [0, 0, 2]]


def test_codes_restore_the_entries(spark):
    got, books = codes.compress(frame(spark, rows_of(n=90)))
    rows = got.where(F.col("vec_id") == 2).limit(1).collect()
    numbers = np.array([[int(r.code[k : k + 2], 16) for k in range(0, 32, 2)] for r in rows])
    vector = codes.integers(pa.array([[-0.001] * 32], pa.list_(pa.float32())), 32, books.most)
    assert ((vector - books.restored(numbers)) ** 2).sum() == rows[0].error
