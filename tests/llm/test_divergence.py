import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from lineaspark.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n string, V int, block int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", a or "", b or "") for t, a, b in rows):
        found = TERM.findall(text.translate(LOW))
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            words = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", words)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    words = ["the", "The", "of", "déjà", "été", "ÉTÉ", "naïve", "x1y", "don't", "语言 模型", "a_b", "[c]", "𝔘nicode", "and,or", " ", "é"]
    rows = []
    for k in range(260):
        lang = rng.choice(["en", "en", "en", "fr", None, ""])
        source = rng.choice(["s0"] * 6 + ["s1", "s2", None, "", "Ü"])
        some = words if source == "s0" else words[: rng.randint(3, len(words))]
        rows.append((" ".join(rng.choices(some, k=rng.choice([0, 1, 5, 40]))) + rng.choice(["", "\n", "."]), lang, source))
    rows += [(None, "en", "s0"), ("", "en", "nothing"), ("123 456", "en", "digits"), ("only here", "de", "one"), ("w" * 3_000_000 + " the " * 3000, "en", "s1")]
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(k, *r, "t", "n", 1, 2) for k, r in enumerate(rows)], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("block", "parts", "broadcast_rows"), [(1 << 16, 4, 100_000), (3, 1, 0)])
def test_against_plain_counting(spark, block, parts, broadcast_rows):
    rows = corpus()
    got = divergence.audit(frame(spark, rows, parts), min_docs=6, top=4, block=block, broadcast_rows=broadcast_rows).collect()
    assert sorted(map(tuple, got)) == plain(rows, 6, 4)


def test_no_rows_and_no_kept_terms(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    got = divergence.audit(frame(spark, [("a b", "en", "x"), ("c", "en", "y"), ("", "fr", None)])).collect()
    assert sorted(map(tuple, got)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_workers_send_what_they_hold_in_parts(monkeypatch):
    rows = corpus()
    whole = pa.Table.from_batches(_tables(rows))
    monkeypatch.setattr(divergence, "HELD", 10)
    monkeypatch.setattr(divergence, "CHUNK", 200)
    parts = pa.Table.from_batches(_tables(rows))
    assert parts.num_rows > whole.num_rows
    total = lambda t: sorted(map(repr, t.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("d", "sum")]).to_pylist()))
    assert total(parts) == total(whole)


def _tables(rows):
    batch = pa.RecordBatch.from_pylist([{"text": t or "", "lang": a or "", "source": s or ""} for t, a, s in rows])
    return list(divergence._counted(iter([batch.slice(0, 100), batch.slice(100, 0), batch.slice(100)])))


def test_a_collision_does_not_join_terms():
    low = np.frombuffer(b"ab cd ab ef cd ab gh gh abc abc", np.uint8)
    start, end = divergence.boundaries(low, np.array([0, len(low)]))
    words = [bytes(low[a:b]) for a, b in zip(start, end, strict=True)]
    for digest in (lambda b: 7, len, lambda b: b[0]):
        term, first = divergence.grouped(low, start, end, digest)
        assert [words[first[t]] for t in term] == words and len(first) == len(set(words))


def test_terms_end_where_texts_do():
    low = np.frombuffer("abécd".encode(), np.uint8)
    start, end = divergence.boundaries(low, np.array([0, 0, 2, 2, 6]))
    assert list(zip(start.tolist(), end.tolist(), strict=True)) == [(0, 2), (2, 6)]


def test_sparse_differences_against_dense_ones():
    rng = np.random.default_rng(2)
    for n, terms in ((2, 1), (5, 40), (9, 7), (3, 0)):
        least = rng.integers(1, 50, n)
        dense = np.repeat(least[:, None], terms, 1)
        has = rng.random((n, terms)) < 0.3
        has[n // 2] = False
        dense[has] = rng.integers(1, 200, has.sum())
        source, term = np.nonzero(has)
        for g, sums in divergence.differences(source, term, dense[has], least, terms):
            assert sums.tolist() == [int(np.abs(dense[h] - dense[g]).sum()) for h in range(g + 1, n)]


def test_shares_are_exact_for_great_counts(spark):
    rows = [(3 * 10**17, 7 * 10**17, 10**6), (0, 10**18, 1), (10**18, 10**18, 0)]
    got = spark.createDataFrame(rows, "n bigint, total bigint, V bigint").select(divergence._share("n", "total")).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in rows]
