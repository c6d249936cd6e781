import random

from lineaspark.llm import unit_dedup as ud

SCHEMA = "doc_id bigint, text string, start string, h1 int, removed string"


def plain(rows, least=8):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        text, at = t or "", 0
        parts = []
        for k, c in enumerate(text + "\n"):
            stop = c == "\n" or (k and text[k - 1] in ".!?" and c == " ")
            if stop:
                parts.append((at, k))
                at = k + (c == "\n")
        for a, b in parts:
            w = text[a:b].split()
            if len(w) >= least:
                while text[a].isspace():
                    a += 1
                b = a + len(text[a:b].strip())
                key = " ".join(w).lower()
                if key in seen:
                    out.append((i, a, b, *seen[key]))
                else:
                    seen[key] = (i, a)
    return out


def corpus():
    rng = random.Random(6)
    pool = [" ".join(rng.choices(["aa", "bé", "Cc", "d", "e,"], k=rng.choice([2, 7, 8, 12, 30]))) + rng.choice([".", "!", "", " ."]) for _ in range(80)]
    rows = [(k, rng.choice([" ", "\n", "  ", " \n "]).join(rng.choices(pool, k=rng.randrange(12)))) for k in range(150)]
    return rows + [(200, None), (201, ""), (202, ("z " * 40 + "\n") * 500), (203, rows[5][1].upper()), (-1, "w " * 60_000)]


def test_removed_units_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "s", 1, "x") for r in rows], SCHEMA).repartition(5)
    want = plain(rows)
    assert sorted(map(tuple, ud.repeats(df).collect())) == sorted(want)
    gone = {}
    for i, a, b, *_ in want:
        gone.setdefault(i, set()).update(range(a, b))
    out = ud.dedup_units(df)
    assert set(out.columns) == set(df.columns)
    for r in out.collect():
        t = dict(rows)[r.doc_id]
        assert r.text == (None if t is None else "".join(c for k, c in enumerate(t) if k not in gone.get(r.doc_id, ())))


def test_passage_inside_lines_is_found(spark):
    passage = "Here is the first sentence of it all today. And then a second one follows right behind it here."
    rows = [(1, f"one two {passage} three", "", 0, ""), (2, f"Other start. {passage} end", "", 0, "")]
    got = ud.repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.doc_id, r.kept_doc_id) for r in got] == [(2, 1)]


def test_null_ids_and_empty(spark):
    assert ud.repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ud.dedup_units(spark.createDataFrame([], SCHEMA), least_run=5).collect() == []
    t = "a b c d e f g h i"
    got = ud.repeats(spark.createDataFrame([(None, t, "", 0, ""), (4, t, "", 0, ""), (4, t, "", 0, "")], SCHEMA)).collect()
    assert [(r.doc_id, r.kept_doc_id) for r in got] == [(4, None), (4, None)]


def test_rows_that_share_an_id_are_told_apart(spark):
    s, t = "one two three four five six seven eight nine", "these words stand here alone and nobody else has them " * 3
    rows = [(0, s, "", 0, ""), (1, s, "", 0, ""), (1, t, "", 0, ""), (5, s.upper(), "", 0, ""), (5, s.upper(), "", 0, ""), (None, t[:9], "", 0, ""), (None, "x", "", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted((r.doc_id, r.start, r.end, r.kept_doc_id) for r in ud.repeats(df).collect()) == [(1, 0, len(s), 0), (5, 0, len(s), 0), (5, 0, len(s), 0)]
    left = sorted((-1 if r.doc_id is None else r.doc_id, r.text, len(r.removed)) for r in ud.dedup_units(df).collect())
    assert left == sorted([(0, s, 0), (1, "", 1), (1, t, 0), (5, "", 1), (5, "", 1), (-1, t[:9], 0), (-1, "x", 0)])
    # of equal rows with one id, and of no other, one stays
    twice = spark.createDataFrame([(5, s, "", 0, ""), (5, s, "", 0, ""), (5, t, "", 0, "")], SCHEMA)
    assert [(r.doc_id, r.kept_doc_id) for r in ud.repeats(twice).collect()] == [(5, 5)]
    assert sorted(r.text for r in ud.dedup_units(twice).collect()) == sorted(["", s, t])


def test_short_runs_stay(spark):
    rng = random.Random(5)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    notice, a, b, c = line(9) + ".", line(9) + ".", line(8) + ".", line(30) + "."
    texts = [f"{notice} {a} {b} {line(3)}. {c}", f"{line(12)}. {notice} {line(12)}.", f"{line(9)}. {a} {b} {line(40)}.", f"{line(12)}. {a} {line(4)}. {b}", f"{c}\n{notice}"]
    df = spark.createDataFrame([(k, t, "", 0, "") for k, t in enumerate(texts)], SCHEMA)
    gone = lambda **k: sorted((r.doc_id, texts[r.doc_id][r.start : r.end]) for r in ud.repeats(df, **k).collect())
    assert gone() == sorted([(1, notice), (2, a), (2, b), (3, a), (3, b), (4, c), (4, notice)])
    assert gone(least_run=17) == sorted([(2, a), (2, b), (4, c), (4, notice)])
    assert gone(least_run=18) == sorted([(4, c), (4, notice)])
    left = {r.doc_id: r.text for r in ud.dedup_units(df, least_run=17).collect()}
    assert left[1] == texts[1] and left[3] == texts[3] and left[4] == "\n" and a not in left[2]


def removed_share(text, rows):
    gone = {k for r in rows for k in range(r.start, r.end)}
    return len(gone & set(range(len(text)))) / len(text)


def test_passages_of_short_units_are_found(spark, tmp_path):
    rng = random.Random(2)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    lists = "\n".join(line(rng.randrange(1, 6)) for _ in range(25))
    mixed = ". ".join(line(n) for n in (12, 3, 2, 9, 4, 4, 5, 3, 2, 1, 6, 2, 30, 3, 3, 1, 2))
    chinese = "\n".join("".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(11)) for _ in range(12))
    sentence = "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(40)) + chr(0x3002)
    alone = line(7)
    passages = [lists, mixed, chinese]
    rows = [(k, f"{line(9)}\n{p}\n{line(9)}", "", 0, "") for k, p in enumerate([*passages, alone, "\u4e01" + chr(0x3002) + sentence])]
    rows += [(k + 10, f"{line(11)}\n{p}\n{line(11)}", "", 0, "") for k, p in enumerate([*passages, alone.upper(), "\u4e02" + chr(0x3002) + sentence])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = ud.op2(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in found} == {(10, 0), (11, 1), (12, 2), (14, 4)}
    left = {r.doc_id: r.text for r in ud.dedup_units(spark.createDataFrame(rows, SCHEMA), passage=ud.PASSAGE).collect()}
    for k, p in enumerate(passages):
        assert p in left[k] and not any(x in left[k + 10] for x in p.split("\n"))
        share = removed_share(rows[k + 5][1], [r for r in found if r.doc_id == k + 10])
        assert abs(share - len(p) / len(rows[k + 5][1])) < 0.02
    assert alone.upper() in left[13]


def plain_query(rows, least=8, passage=25, run=20):
    """Units, windows and runs of a corpus of spaced scripts, by plain lists."""
    found = {}
    for i, text in rows:
        parts, at, before = [], 0, 0
        text = text or ""
        for k in range(len(text) + 1):
            if k == len(text) or text[k] == "\n" or (text[k] == " " and k and text[k - 1] in ".!?"):
                words = text[at:k].split()
                if words:
                    a = at + len(text[at:k]) - len(text[at:k].lstrip())
                    parts.append((a, a + len(text[at:k].strip()), before, before + len(words), " ".join(words).lower()))
                    before += len(words)
                at = k + (k < len(text) and text[k] == "\n")
        spans = {(k, k + 1) for k, p in enumerate(parts) if p[3] - p[2] >= least}
        for k, p in enumerate(parts):
            if p[3] - p[2] < least:
                on = [z for z in range(k + 1, len(parts) + 1) if parts[z - 1][3] - p[2] >= passage]
                back = [a for a in range(k + 1) if p[3] - parts[a][2] >= passage]
                spans |= {(k, on[0])} if on else set()
                spans |= {(back[-1], k + 1)} if back else set()
        found[i] = [(" ".join(p[4] for p in parts[a:z]), parts[a][0], parts[z - 1][1], parts[a][2], parts[z - 1][3]) for a, z in sorted(spans)]
    first = {}
    for i in sorted(found):
        for key, a, *_ in found[i]:
            first[key] = min(first.get(key, (i, a)), (i, a))
    out = []
    for i, mine in found.items():
        again, held, end = sorted((w0, w1, a, z, *first[key]) for key, a, z, w0, w1 in mine if first[key] != (i, a)), [], -1
        for x in [*again, (10**9, 0)]:
            if held and x[0] > end:
                if end - held[0][0] >= run:
                    out += [(i, *y[2:]) for y in held]
                held, end = [], -1
            held.append(x)
            end = max(end, x[1])
    return sorted(out)


def test_the_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(13)
    unit = lambda n: " ".join(rng.choices(["aa", "bé", "Cc", "d", "e,", "ff"], k=n))
    pool = [unit(rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 19, 20, 30])) + rng.choice([".", "!", "", " .", "?"]) for _ in range(60)]
    texts = [rng.choice([" ", "\n", "  "]).join(rng.choices(pool, k=rng.randrange(14))) for _ in range(120)]
    for _ in range(60):  # stretches of other texts
        t = rng.choice(texts)
        a = rng.randrange(len(t) + 1)
        texts.append(f"{unit(6)}. {t[a : a + rng.randrange(1500)]}\n{unit(9)}")
    rows = [(3 * k - 20, t) for k, t in enumerate([*texts, None, "", "x " * 500])]
    spark.createDataFrame([(*r, "s", 1, "x") for r in rows], SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_query(rows)
    assert len(want) > 300
    assert sorted(map(tuple, ud.op2(spark, str(tmp_path)).collect())) == want
