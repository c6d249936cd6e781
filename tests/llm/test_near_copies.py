import itertools
import os
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from lineaspark.llm import near_copies, shingles

from .test_simhash import plain_fingerprint

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(texts):
    """The least row of each row's group."""
    sets, up = [grams(t) for t in texts], list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
            x, y = sorted((top(i), top(j)))
            up[y] = x
    return [top(i) for i in range(len(texts))]


def corpus():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 4, 20, 60, 200, 700]))) for _ in range(60)]
    common = " ".join(rng.choices(words, k=40))
    texts += [common + " " + " ".join(rng.choices(words, k=30)) for _ in range(30)]
    for t in texts[:90]:
        for changed in rng.sample([1, 2, 4, 8, 15], 2):
            w = t.split()
            for _ in range(changed):
                w[rng.randrange(len(w))] = rng.choice(words).upper()
            texts.append("\n".join(w))
    return [*texts, texts[5], texts[5].upper(), "x" * 600_000 + " a b c d e", "y " * 200_000]


def test_stage_removes_all_near_copies_of_similarity_four_fifths(spark):
    texts = corpus()
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    far = [(a, b) for a, b in itertools.combinations(range(120), 2) if len(grams(texts[a]) & grams(texts[b])) * 5 >= 4 * len(grams(texts[a]) | grams(texts[b]))]
    assert any((plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).bit_count() > 4 for a, b in far)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = {r.doc_id for r in stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == set(groups(texts))


def test_blocks_lose_no_link(spark):
    texts = corpus()[:150]
    docs = near_copies.numbered(spark.createDataFrame([(k, t, "", "", 0) for k, t in enumerate(texts)], SCHEMA), None)
    got = near_copies.labels(docs.select("_doc", "text"), near_copies.Scratch(spark, "t"), block=2, set_block=2).collect()
    assert [r.least.doc_id for r in sorted(got, key=lambda r: r._doc.doc_id)] == groups(texts)


def test_rows_without_or_with_repeated_ids(spark):
    rows = [(None, "a b c d e f", "", "", 0), (None, "A b c d e f", "", "", 0), (7, "one two three four five", "", "", 0), (7, "quite other words are standing here", "", "", 0), (8, "one two three four five", "", "", 0)]
    got = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text.lower() for r in got) == ["a b c d e f", "one two three four five", "quite other words are standing here"]
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chunks_do_not_matter():
    rng = random.Random(1)
    text = " ".join(rng.choices(["ab", "c", "déf", "g" * 50], k=40_000))
    assert len(text) > shingles.CHUNK and len(near_copies.shingle_set(text)) == len(grams(text))
    assert np.array_equal(near_copies.shingle_set("  " + text.replace(" ", "\n")), near_copies.shingle_set(text))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_real_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {rows[k][0] for k in groups([t for _, t in rows])}
    assert len(want) < len(rows) - 20
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == want


def test_unrelated_texts_do_not_pass_the_gate():
    """Of prints of unrelated sets hardly a pair passes, whatever cell they meet in; of sets at similarity 0.8 every pair does."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**64, 200, np.uint64)) for _ in range(600)]
    near = [np.unique(np.concatenate([s[20:180], s[180:190], rng.integers(0, 2**64, 10, np.uint64)])) for s in sets[:100]]
    table = lambda x: pa.table({"n": [len(s) for s in x], **dict(zip(near_copies._PRINTS, zip(*map(near_copies._fingerprint, x), strict=True), strict=True))})
    assert len(near_copies._coarse(table(sets), 0, len(sets))[0]) <= 3  # of 180,000 pairs
    both = [s for pair in zip(sets[:100], near, strict=True) for s in pair]
    a, b = near_copies._coarse(table(both), 0, 200)
    assert sorted(zip(a, b, strict=True)) == [(2 * k, 2 * k + 1) for k in range(100)]


def test_the_grid_takes_part_in_the_stage(spark, monkeypatch):
    calls, links = [], near_copies.simhash.links
    monkeypatch.setattr(near_copies.simhash, "links", lambda *a, **k: calls.append(1) or links(*a, **k))
    rows = [(1, "a b c d e f g", "", "", 0), (2, "A b c d e f g", "", "", 0)]
    assert [r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()] == [1] and calls
