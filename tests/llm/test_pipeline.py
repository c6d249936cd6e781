import hashlib
import random

import corpus_pipeline
from lineaspark.llm import hilbert, line_dedup, near_copies, simhash, unit_dedup

from .test_decontaminate import grams
from .test_line_dedup import plain as removed
from .test_near_copies import groups

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(31)
    langs = {"en": "the of and ing ed er tion".split(), "fr": "le des eau ment que oi tre".split(), "de": "der und sch ein ung ist zu".split()}
    line = lambda lang: " ".join("".join(rng.choices(langs[lang], k=2)) for _ in range(12))
    rows, items = [], [(k, line("en") + " " + line("en")) for k in range(3)]
    for k in range(90):
        lang = rng.choice(sorted(langs))
        rows.append([k, "\n".join(line(lang) for _ in range(rng.randrange(2, 8))), lang, "s", 0])
    for k in range(90, 100):  # near copies: one word changed in a long text
        base = max(rows[:60], key=lambda r: (len(r[1]) + 31 * r[0] * k) % 997)
        words = base[1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append([k, " ".join(words).replace("\n", " "), base[2], "s", 0])
    rows.append([100, rows[3][1], rows[3][2], "s", 0])  # a copy
    rows.append([101, line("en") + " " + items[1][1].upper() + " " + line("en"), "en", "s", 0])
    rows += [[102, None, "en", "s", 0], [103, "12 34", None, "s", 0], [104, "", "en", None, None]]
    return [tuple(r) for r in rows], items


def test_each_stage_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    now = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
        now = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert set(before) - set(now) == {102, 103, 104}
        elif name == "line_dedup":
            order = sorted(before.items())
            for (i, t), gone in zip(order, removed(order), strict=True):
                left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
                assert (i not in now) if gone and not left.strip() else now[i].text == left
            assert all(r.n_chars == len(r.text) for r in now.values())
            assert 100 not in now
        elif name == "near_dedup":
            order = sorted(before.items())  # similarity 0.8 or more of 5-word shingles, by all pairs
            assert sorted(now) == sorted({order[k][0] for k in groups([t for _, t in order])}) and len(now) < len(before)
        elif name == "decontamination":
            bad = {i for i, t in before.items() for _, x in items if len(grams(x) & grams(t, 5)) * 5 >= 4 * len(grams(x))}
            assert bad == {101} and set(now) == set(before) - bad
        else:
            assert set(now) == set(before)
            assert all(r.decoded_sha256 == hashlib.sha256(before[i].encode()).hexdigest() for i, r in now.items())
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(now)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(corpus()[1], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_names_and_odd_rows(spark, tmp_path):
    rows, items = corpus()
    names = ("_doc", "_rest", "_cut", "_all", "_key", "_removed", "seq", "node", "grp", "line.no")
    odd = [(*r, *(f"{n} {r[0]}" for n in names)) for r in [*rows[:40], (None, rows[0][1], "en", "s", 0), (5, rows[50][1], "en", "s", 0), (None, None, None, None, None)]]
    kind = SCHEMA + "".join(f", `{n}` string" for n in names)
    docs = spark.createDataFrame(odd, kind)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for work in (line_dedup.dedup_lines, near_copies.keep_one, simhash.keep_one, lambda d: unit_dedup.dedup_units(d).drop("removed")):
        back = work(docs)
        assert back.columns == docs.columns
        assert all(r[n] == f"{n} {r.doc_id}" for r in back.collect() for n in names)
    hilbert.write(docs, str(tmp_path / "shards"), shards=3)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(odd)
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 30 < len(got) <= 42 and all(len(r.ids_sha256) == 64 for r in got)
