import collections
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lineaspark.llm import language_id as lid
from lineaspark.llm.shared import Scratch

SCHEMA = "doc_id bigint, text string, lang string, score double, bin string"
WORDS = {"aa": "the of and ing tion ed er".split(), "bb": "der und ist ein ung sch zu".split(), "cc": "el los ción que ó ña por".split(), "dd": "le des é eau ai ç tre".split(), "ee": "og det ikke å ø ble til".split()}


def corpus(n=300):
    rng = random.Random(2)
    langs = sorted(WORDS)
    rows = []
    for k in range(n):
        lang = langs[k % len(langs)]
        rows.append((k, " ".join("".join(rng.choices(WORDS[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 80))).capitalize(), lang, 0.5, "b"))
    return rows


def test_held_out_accuracy_and_edge_rows(spark):
    rows = corpus() + [(1000, None, "aa", 0.0, ""), (1001, "", "aa", 0.0, ""), (1002, " 12 %\n", None, 0.0, ""), (None, "der und ist", None, 0.0, ""), (3, "the of and", None, 0.0, ""), (1003, "x " * 150_000, None, 0.0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    model = lid.fit(df, Scratch(spark, "t"))
    assert model.langs == sorted(WORDS) and model.code.shape == (5, 15)
    got = lid.predict(df, model).withColumn("held", lid.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 300 and r[0] != 3}
    judged = [r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth and r.held]
    assert len(judged) > 30 and np.mean(judged) > 0.97
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1000, 1001, 1002}
    assert all(0 <= r.score <= 1 for r in got)
    kept = lid.keep_known(df, model)
    assert kept.columns == df.columns and not {1000, 1001, 1002} & {r.doc_id for r in kept.collect()}
    again = lid.predict(df.drop("lang"), model).collect()
    assert sorted(map(str, again)) == sorted(str(r).replace(f", held={r.held}", "") for r in got)


def test_nothing_to_learn_and_empty(spark):
    df = spark.createDataFrame([(1, "text", None, 0.0, ""), (2, "more", None, 0.0, "")], SCHEMA)
    model = lid.fit(df, Scratch(spark, "t"))
    assert {r.lang_pred for r in lid.predict(df, model).collect()} == {"und"}
    one = lid.fit(spark.createDataFrame(corpus()[::5], SCHEMA), Scratch(spark, "t"))
    assert {r.lang_pred for r in lid.predict(df, one).collect()} == {"aa"}
    assert lid.predict(spark.createDataFrame([], SCHEMA), one).collect() == []


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12, 60):
        code = lid.codewords(n).astype(int)
        far = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(far) >= (code.shape[1] + 1) // 2 if n <= 7 else min(far) >= code.shape[1] // 4


def test_ngrams_ignore_what_is_no_letter():
    assert sorted(lid.ngrams("Ab, c!")) == sorted(lid.ngrams("aB   C 12"))
    assert len(lid.ngrams("12 34")) == len(lid.ngrams("")) == len(lid.ngrams(None)) == 0


def test_margins_and_decoding_against_plain_sums(spark):
    rows = corpus(120)
    df = spark.createDataFrame(rows, SCHEMA)
    model = lid.fit(df, Scratch(spark, "t"), sample_docs=10_000)
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    counts = {lang: collections.Counter(b for r in known if r[2] == lang for b in lid.ngrams(r[1]).tolist()) for lang in model.langs}
    share = lambda lang, b: (counts[lang][b] + 0.5) / (sum(counts[lang].values()) + 0.5 * lid.BINS)

    def margins(text):
        bins = lid.ngrams(text).tolist()
        out = []
        for bit in range(model.code.shape[1]):
            one, zero = ([x for x, c in zip(model.langs, model.code[:, bit], strict=True) if c == side] for side in (1, -1))
            out.append(sum(math.log(sum(share(x, b) for x in one) / len(one)) - math.log(sum(share(x, b) for x in zero) / len(zero)) for b in bins) / len(bins))
        return out

    right, n = np.zeros(model.code.shape), np.zeros(len(model.langs))
    for r in known[:200]:
        i = model.langs.index(r[2])
        right[i] += np.sign(model.margins(r[1])) == model.code[i]
        n[i] += 1
    trust = (right + 1) / (n[:, None] + 2)
    assert np.allclose(model.trust, trust / trust.sum(axis=1, keepdims=True))
    for r in rows[::7]:
        f = margins(r[1])
        assert np.allclose(model.margins(r[1]), f, atol=1e-4)
        far = [sum(math.log1p(math.exp(-4 * c * m)) * t for c, m, t in zip(code, f, w, strict=True)) for code, w in zip(model.code.tolist(), model.trust.tolist(), strict=True)]
        near, second = sorted(far)[:2]
        lang, score, doubt = model.decode(model.margins(r[1]))
        assert lang == model.langs[far.index(near)] and doubt == (second - near < 0.05 * second)
        assert math.isclose(score, 1 / sum(math.exp(8 * (near - x)) for x in far), rel_tol=1e-3)


def test_the_most_frequent_languages_are_learned(spark):
    rows = corpus(100) + [(200 + k, "some words here", f"junk {k}", 0.0, "") for k in range(30)]
    model = lid.fit(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"), most_langs=5)
    assert model.langs == sorted(WORDS)
    one = next(k for k in range(9) if zlib.crc32(str(k).encode()) % 5)
    alike = [(one, r[1], r[2], 0.0, "") for r in corpus(1000)]  # rows that share an id are sampled one by one
    scratch = Scratch(spark, "t")
    lid.fit(spark.createDataFrame(alike, SCHEMA), scratch, sample_docs=250)
    assert 150 < spark.read.parquet(f"{scratch.base}/sample").count() < 350
