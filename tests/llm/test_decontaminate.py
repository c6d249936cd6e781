import random
import re

from lineaspark.llm import decontaminate as dc

SCHEMA = "doc_id bigint, text string, item_id string, n_shared int"


def grams(text, k=None):
    w = re.findall("[a-z0-9_\u0080-\U0010ffff]+", re.sub("[ -¿×÷ -⯿　-〿＀-／]", " ", (text or "").lower()))
    k = k or min(5, len(w)) or 1
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def corpus():
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(300)] + ["É", "“quoted”", "don't", "x–y"]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 4, 5, 6, 14, 30, 59, 200])))) for k in range(50)]
    docs = []
    for k in range(300):
        words = rng.choices(vocab, k=rng.choice([3, 40, 500]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            part = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):  # damage
                part[rng.randrange(len(part))] = "zz"
            if rng.random() < 0.3:
                part = [x.upper() + "***" for x in part]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((k, rng.choice([" ", "\n", " \t"]).join(words)))
    long = "filler words here " * 120_000 + items[7][1] + " more" * 50
    docs += [(300, None), (301, ""), (302, "..."), (303, long), (None, items[9][1]), (5, items[8][1])]
    items += [(50, None), (51, ""), (52, "!?"), (3, items[3][1])]
    return docs, items


def test_all_pairs_match_brute_force(spark):
    docs, items = corpus()
    want = []
    for i, t in items:
        s = grams(t)
        for d, x in docs:
            if s and (n := len(s & grams(x, len(next(iter(s)))))) * 5 >= len(s) * 4:
                want.append((d, i, len(s), n, n / len(s)))
    df = spark.createDataFrame([(*d, "i", 1) for d in docs], SCHEMA).repartition(4)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    key = lambda r: (r[0] is not None, r)
    for block in (32 << 20, 3000):
        got = dc.contained(df, bench, block)
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert len(want) > 100
    kept = dc.keep_clean(df, bench, 3000).collect()
    bad = {r[0] for r in want}
    assert sorted((r.doc_id for r in kept if r.doc_id != 5)) == sorted(d for d, _ in docs if d not in bad and d != 5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert dc.contained(none, bench).collect() == []
    some = spark.createDataFrame([(1, "a b c d e f", "", 0)], SCHEMA)
    assert dc.contained(some, bench.limit(0)).collect() == []
    assert dc.keep_clean(some, bench.limit(0)).count() == 1


def test_many_blocks_are_searched_one_after_another(spark, monkeypatch):
    """A plan never holds more than one Python stage over the texts, and every way gives the same rows, shuffled or broadcast."""
    rng = random.Random(4)
    items = [(k, f"item {k} " + " ".join(rng.choices("abcdefgh", k=6))) for k in range(60)]
    docs = [(k if k % 9 else None, f"text {k} {items[k][1] if k % 3 == 0 and k < 60 else ''} end", "i", 1) for k in range(90)]
    df, bench = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    stages, table = [], dc.Scratch.table

    def counted(self, frame, name):
        stages.append(frame._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        return table(self, frame, name)

    monkeypatch.setattr(dc.Scratch, "table", counted)
    whole = sorted(map(str, dc.keep_clean(df, bench).collect()))
    assert len(whole) == 70 and not stages
    for few in (1_000_000, 0):
        assert sorted(map(str, dc.keep_clean(df, bench, 900, few).collect())) == whole
    assert max(stages) == 1 and sum(stages) >= 10
