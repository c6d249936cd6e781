import itertools
import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lineaspark.llm import near_copies, simhash

SF = "/root/testdata/sf0.01"

SCHEMA = "doc_id bigint, text string, cell string, fp int, a string"


def plain_fingerprint(text):
    words, now = [], ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [now] if now else []
            now = ""
        else:
            now += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(rows, bits=4):
    ids, fps = [r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            up[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(ids[i])
    return sorted((ids[i], f"{fps[i]:016x}", min(groups[top(i)])) for i in range(len(rows)))


def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows, texts = [], []
    for _ in range(60):
        texts.append(" ".join(rng.choices(words, k=rng.choice([1, 3, 4, 30, 200, 900]))))
    for t in texts[:25]:
        for _ in range(rng.choice([1, 2, 8])):
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(words).upper()
            texts.append("\n".join(w))
    texts += [None, "", " \t\n", texts[3], texts[3].upper(), "É é ＊", "x" * 50_000]
    rng.shuffle(texts)
    return [(1000 - k, t, "c", 1, "z") for k, t in enumerate(texts)]


def test_matches_brute_force(spark):
    rows = corpus()
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == plain_components([r[:2] for r in rows])


def test_grid_join_loses_no_link(spark):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in fps[:100]:
        for n in (1, 2, 3, 4, 4, 4, 5):
            g = f
            for k in rng.sample(range(64), n):
                g ^= 1 << k
            fps.append(g)
    fps = sorted({f - (f >> 63 << 64) for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for block in (8192, 3):
        got = {tuple(r) for r in simhash.links(df, simhash.Scratch(spark, "t"), 4, block).collect()}
        want = {(x, y) for x, y in itertools.combinations(fps, 2) if (x ^ y & (1 << 64) - 1).bit_count() <= 4 or ((x ^ y) & (1 << 64) - 1).bit_count() <= 4}
        assert got <= want

        def parts(pairs):
            up = {f: f for f in fps}

            def top(i):
                while up[i] != i:
                    i = up[i]
                return i

            for x, y in pairs:
                up[top(x)] = top(y)
            return {frozenset(f for f in fps if top(f) == t) for t in map(top, fps)}

        assert parts(got) == parts(want)


def test_empty_nulls_and_keep_one(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).collect() == []
    rows = [(1, "a b c d e", "", 0, ""), (2, "A b c d e", "", 0, ""), (3, "other words stand in here", "", 0, ""), (3, "other words stand in here", "", 0, ""), (None, "quite another set of words", "", 0, ""), (None, "a b c d e", "", 0, "")]
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "cell", "fp", "a"]
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "a b c d e"), (0, "quite another set of words"), (3, "other words stand in here")]
    twice = spark.createDataFrame([(7, "one text of some words", "", 0, ""), (7, "quite another text of other words", "", 0, ""), (9, "one text of some words", "", 0, "")], SCHEMA)
    assert sorted(r.text for r in simhash.keep_one(twice, bits=0).collect()) == ["one text of some words", "quite another text of other words"]


def test_a_chain_is_one_component(spark):
    from lineaspark.llm.components import components

    edges = spark.range(0, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(edges, simhash.Scratch(spark, "t")).collect()
    assert len(got) == 301 and {r.root for r in got} == {0}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_recall_on_real_documents(spark):
    """No pair within 4 bits is missed; what the fingerprint itself leaves out of pairs of similarity 0.8 is its own limit."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    fps = np.array([simhash.fingerprint(t) for _, t in rows], np.int64).view(np.uint64)
    group = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :])
    linked = [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(near <= 4), strict=True) if i < j]
    assert linked and all(group[a] == group[b] for a, b in linked)
    up = {d: d for d, _ in rows}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in linked:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    assert group == {d: top(d) for d, _ in rows}
    by = {}  # pairs of different texts that share a rare shingle, for the share of similar ones that 4 bits can see
    sets = {d: set(near_copies.shingle_set(t).tolist()) for d, t in rows}
    for d, s in sets.items():
        for h in s:
            by.setdefault(h, []).append(d)
    pairs = {p for v in by.values() if 1 < len(v) < 50 for p in itertools.combinations(v, 2)}
    alike = [(a, b) for a, b in pairs if sets[a] != sets[b] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]
    print(f"{sum(group[a] == group[b] for a, b in alike)} of {len(alike)} pairs at 0.8 are linked within 4 bits")
