import random

import pytest

from lineaspark.llm import line_dedup

SCHEMA = "doc_id bigint, text string, gone string, seq int, n_lines int"


def own_lines(text):
    return [(n, x) for n, x in enumerate(text.split("\n")) if x.strip("\t\x0b\f\r ")] if text is not None else []


def plain(rows, least=2):
    """Line numbers that go, by row; rows in order of id."""
    seen, gone = set(), [set() for _ in rows]
    for k, (_, text) in enumerate(rows):
        lines = own_lines(text)
        for j in range(len(lines) - least + 1):
            some = lines[j : j + least]
            key = tuple(x for _, x in some)
            if key in seen:
                gone[k] |= {n for n, _ in some}
            seen.add(key)
    return gone


def plain_runs(rows, least):
    """(first-last, document:line+length) of every deleted run, by row."""
    first, out = {}, []
    every = [own_lines(t) for _, t in rows]
    for k, lines in enumerate(every):
        for j in range(len(lines) - least + 1):
            first.setdefault(tuple(x for _, x in lines[j : j + least]), (k, j))
    for k, gone in enumerate(plain(rows, least)):
        lines, runs = every[k], []
        at = [j for j, (n, _) in enumerate(lines) if n in gone]
        for a in (j for j in at if j - 1 not in at):
            z = next(j for j in range(a, len(lines) + 1) if j not in at) - 1
            d, f = first[tuple(x for _, x in lines[a : a + least])]
            n = 0
            while a + n < len(lines) and f + n < len(every[d]) and lines[a + n][1] == every[d][f + n][1]:
                n += 1
            runs.append((f"{lines[a][0]}-{lines[z][0]}", f"{rows[d][0]}:{every[d][f][0]}+{n}"))
        out.append(runs)
    return out


def corpus(n=120):
    rng = random.Random(11)
    pool = [f"line {k}" for k in range(60)] + ["", "  ", "é", "line 1 "]
    texts = ["\n".join(rng.choices(pool, k=rng.choice([0, 1, 2, 5, 40]))) for _ in range(n)]
    texts += [texts[3], texts[4] + "\n" + texts[5], None, "", "\n\n", "x\n" * 300, "y" * 100_000 + "\nline 1\nline 2"]
    return [(k * 3, t, "g", 1, 2) for k, t in enumerate(texts)]


def test_removed_runs_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain([r[:2] for r in rows])
    got = {r.doc_id: r for r in line_dedup.report(df).collect()}
    assert len(got) == len(rows)
    for (i, t, *_), gone in zip(rows, want, strict=True):
        assert got[i].n_removed == len(gone)
        assert {n for s in got[i].removed_runs.split(",") if s for n in range(int(s.split("-")[0]), int(s.split("-")[1]) + 1) if (t.split("\n")[n].strip("\t\x0b\f\r "))} == gone
    kept = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    for (i, t, *rest), gone in zip(rows, want, strict=True):
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        if gone and not left.strip():
            assert i not in kept
        else:
            assert kept[i].text == left and [kept[i].gone, kept[i].seq, kept[i].n_lines] == rest


@pytest.mark.parametrize("least", [1, 2, 3, 4, 5, 7])
def test_runs_and_what_they_copy_match_brute_force(spark, least):
    rng = random.Random(21)
    pool = [f"line {k}" for k in range(12)] + ["", " "]
    texts = ["\n".join(rng.choices(pool, k=rng.choice([1, 5, 40]))) for _ in range(25)]
    for _ in range(15):  # long passages, of several documents, and of one itself
        some = rng.choice(texts).split("\n")
        a = rng.randrange(len(some))
        texts.append("\n".join(rng.choices(pool, k=3) + some[a : a + rng.randrange(30)] + rng.choices(pool, k=3) + some[a:]))
    texts += ["x\n" * 50, "a\nb\n" * 20, None, ""]
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "g", 1, 2) for r in rows], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in line_dedup.report(df, least).collect()}
    want = plain_runs(rows, least)
    for (k, _), runs, gone in zip(rows, want, plain(rows, least), strict=True):
        assert (got[k].removed_runs, got[k].kept_runs, got[k].n_removed) == (",".join(a for a, _ in runs), ",".join(b for _, b in runs), len(gone))
    assert any(int(b.split("+")[1]) >= 8 for runs in want for _, b in runs)


def test_levels_double_up_to_the_longest_repeat(spark):
    scratch = line_dedup.Scratch(spark, "t")
    text = "\n".join(f"l{k}" for k in range(20))
    df = spark.createDataFrame([(1, text, "", 0, 0), (2, "z\n" + text, "", 0, 0)], SCHEMA)
    lines = line_dedup.lines_of(line_dedup.numbered(df.select("doc_id", "text"), scratch))
    levels = line_dedup.intervals(lines, scratch)
    assert [x.count() for x in levels] == [2 * (20 - n + 1) for n in (1, 2, 4, 8, 16)]
    # ranks order suffixes: equal ranks share the first lines, and only those
    for x in levels:
        assert all(r["count"] == 2 for r in x.groupBy("rank").count().collect())


def test_repeated_and_null_ids_and_empty(spark):
    rows = [(1, "a\nb", "", 0, 0), (1, "a\nb", "", 0, 0), (None, "a\nb\nc", "", 0, 0), (None, None, "", 0, 0)]
    got = sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in line_dedup.report(spark.createDataFrame(rows, SCHEMA)).collect())
    # null ids come first, so the rows with id 1 are later copies
    assert got == [(0, 0, 0), (0, 3, 0), (1, 2, 2), (1, 2, 2)]
    assert line_dedup.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_later_copies_of_single_long_lines_go(spark):
    words = lambda n, k: " ".join(f"w{k}x{j}" for j in range(n))
    chinese = "".join(chr(0x4E00 + 7 * k) for k in range(60))
    texts = [f"a\n{words(60, 1)}\nb", words(231, 2), f"{chinese}\nc", f"d\n{words(19, 3)}\ne", f"f\n  {words(20, 4)}", "z" * 100_000]
    texts += [f"g\n{words(60, 1)}\nh", words(231, 2), f"i\n{chinese}", f"j\n{words(19, 3)}\nk", f"  {words(20, 4)}\nl", f"{words(60, 1)}\n{words(60, 1)}\nm", "z" * 100_000]
    rows = [(k, t, "", 0, 0) for k, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = dict(enumerate(texts)) | {6: "g\nh", 8: "i", 10: "l", 11: "m"}
    del want[7]  # a document of one line, with an earlier copy
    assert got == want


def test_no_more_levels_than_are_asked_for(spark, monkeypatch):
    names, table = [], line_dedup.Scratch.table
    monkeypatch.setattr(line_dedup.Scratch, "table", lambda self, df, name: names.append(name) or table(self, df, name))
    text = "\n".join(["the same line"] * 64)
    df = spark.createDataFrame([(1, text, "", 0, 0), (2, text, "", 0, 0)], SCHEMA)
    for least, most in ((2, 1), (3, 1), (5, 2)):
        names.clear()
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, min_lines=least).collect()}
        assert got == {1: "the same line"}
        assert max(int(n.split("-")[1]) for n in names if n.startswith("level")) == most
