import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from lineaspark.llm import links, minhash
from lineaspark.llm.near_copies import shingle_set
from lineaspark.llm.shared import Scratch

SCHEMA = "doc_id bigint, text string, n bigint, h1 string, `group` int, node string"


def grams(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(" ")
    words = [w for w in " ".join(words).split() if w]
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {tuple(words)} if words else set()


def forest(n, linked):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in linked:
        x, y = sorted((top(i), top(j)))
        up[y] = x
    return [top(i) for i in range(n)]


def plain(rows):
    sets = [grams(t) for _, t in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    roots, out = forest(len(rows), pairs), []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[k] and rows[j][0] is not None] if sets[k] else [i]
        least = min((x for x in ids if x is not None), default=None)
        out.append((i, len(sets[k]), least, i == least))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 12, 30, 90, 300]))) for _ in range(60)]
    for t in texts[:60]:
        for changed in rng.sample([0, 1, 2, 4, 7, 12], 3):
            w = t.split()
            for _ in range(changed):
                w[rng.randrange(len(w))] = rng.choice(words).upper()
            texts.append("\t".join(w))
    hot = rng.choices(words, k=60)
    for _ in range(60):
        w = list(hot)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [None, "", " \n\t", None, "x", "X", "x x", "é " * 50_000, "long " + "y" * 400_000]
    return texts


@pytest.mark.parametrize(("cell_block", "set_block"), [(4096, 1 << 20), (3, 200)])
def test_against_all_pairs(spark, cell_block, set_block):
    rows = [(k * 7 % 1009, t) for k, t in enumerate(corpus())]
    got = minhash.near_duplicates(spark.createDataFrame([(*r, 1, "h", 2, "n") for r in rows], SCHEMA).repartition(5), cell_block, set_block).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_null_and_repeated_ids_and_no_rows(spark):
    rows = [(None, "a b c"), (None, "A b c"), (None, "p q"), (4, "a b c"), (4, "other words here"), (3, "other words here"), (None, None), (4, None), (4, "")]
    got = minhash.near_duplicates(spark.createDataFrame([(*r, 1, "h", 2, "n") for r in rows], SCHEMA)).collect()
    want = [(None, 2, 4, False)] * 2 + [(None, 1, None, True), (4, 2, 4, True), (4, 2, 3, False), (3, 2, 3, True), (None, 0, None, True), (4, 0, 4, True), (4, 0, 4, True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_all_signatures_under_the_distance_share_a_cell():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, minhash.LENGTH).astype(np.uint16)
        b = a.copy()
        at = rng.permutation(minhash.LENGTH)[: minhash.DISTANCE] if rng.random() < 0.5 else _spread(rng)
        b[at] ^= rng.integers(1, 1 << 16, len(at)).astype(np.uint16)
        x, y = minhash.cells(np.stack([a, b]))
        assert (x == y).any() and len(set(x.tolist())) == minhash.LENGTH
        assert minhash.distance(*minhash.low_bits(np.stack([a, b]))) <= (a != b).sum() <= minhash.DISTANCE


def _spread(rng):
    """Two errors in all chunks but one, which has one: the worst case."""
    spared = rng.integers(minhash.CHUNKS)
    return np.concatenate([c * minhash.SYMBOLS + rng.permutation(minhash.SYMBOLS)[: 1 if c == spared else 2] for c in range(minhash.CHUNKS)])


def test_symbols_differ_as_sets_do():
    rng = np.random.default_rng(1)
    for same in (0.5, 0.8, 0.95):
        differ = []
        for _ in range(60):
            both, n = rng.integers(0, 1 << 63, 3000).astype(np.uint64), int(300 * same)
            rest = (300 - n) // 2
            a, b = np.sort(both[: n + rest]), np.sort(np.concatenate([both[:n], both[-rest:]]))
            differ.append((minhash.signature(a) != minhash.signature(b)).mean())
        j = n / (n + 2 * rest)
        assert abs(np.mean(differ) - (1 - j)) < 0.03


def test_signature_of_a_long_text_takes_all_of_it():
    s = shingle_set(" ".join(f"w{k}" for k in range(5000)), 2)
    whole = minhash.mix((s[:, None] * minhash._ODD).min(axis=0)).astype(np.uint16)
    assert (minhash.signature(s) == whole).all()


def test_met_rows_over_batches():
    rng = random.Random(4)
    for _ in range(300):
        cell = sorted(rng.choices(range(8), k=rng.randint(0, 14)))
        cuts = sorted(rng.choices(range(len(cell) + 1), k=3))
        batches = [pa.RecordBatch.from_arrays([pa.array(cell[s:e], pa.int64()), pa.array(range(s, e), pa.int64())], ["cell", "node"]) for s, e in zip([0, *cuts], [*cuts, len(cell)], strict=True)]
        got = [x for b in links.met(iter(batches)) for x in b.column("node").to_pylist()]
        assert sorted(got) == [k for k, c in enumerate(cell) if cell.count(c) > 1]


@pytest.mark.parametrize("weight", [None, "n"])
def test_blocks_lose_no_link_whoever_comes_first(spark, weight):
    rng = random.Random(9)
    values = {k: rng.choice([0, 0, 0, 40, 41, 90, 91, 92, 200 + k]) + rng.randint(0, 3) for k in range(220)}
    rows = [(k % 3, k, v, rng.randint(1, 9)) for k, v in values.items()] + [(9, k, values[k], 1) for k in range(0, 220, 7)]

    def near(table, s, e):
        v = table.column("v").slice(s, e - s).to_numpy()
        return links.grown(e - s, lambda u, rest: rest[np.abs(v[rest] - v[u]) <= 1])

    df = spark.createDataFrame(rows, "cell bigint, node bigint, v bigint, n bigint").repartition(3)
    got = [(r.a, r.b) for r in links.linked(df, "cell", near, Scratch(spark, "t"), "t", 10, weight).collect()]
    assert all(abs(values[a] - values[b]) <= 1 for a, b in got)
    cells = {}
    for c, k, *_ in rows:
        cells.setdefault(c, []).append(k)
    want = [(a, b) for ks in cells.values() for a, b in itertools.combinations(ks, 2) if abs(values[a] - values[b]) <= 1]
    assert forest(220, got) == forest(220, want)
