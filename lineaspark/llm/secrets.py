"""Secret scans by a trigram inverted index.

From each rule's regex a Boolean trigram query is derived: a disjunction of
trigram sets, one of which any match must hold whole.  The index lists, for
every trigram that a rule asks for, the documents that hold it (lower-cased, so
a query may answer too much and never too little).  Intersecting postings gives
each rule's candidate documents, and only those are verified with the regex.  A
rule without a mandatory trigram, such as a run of hex digits, scans fully.
Everything is DataFrame expressions; texts are shuffled only if the candidates
are too many to broadcast.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .shared import Scratch

TRUE = frozenset([frozenset()])
CHUNK = 256
MOST = 64  # exact strings that are followed through a pattern at once


@dataclass(frozen=True)
class Rule:
    """``pattern`` must mean the same to Java and Python; ``least`` is the length of ``group`` that a match needs."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + f"|{_either('api')}_?{_either('key')}"

#: The three base kinds, in the order in which ties are listed.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What this operator adds.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE + ADDED


def _absorb(query: set[frozenset[str]]) -> frozenset[frozenset[str]]:
    """Drop what is implied: a set that holds another set whole."""
    return frozenset(q for q in query if not any(o < q for o in query))


def _and(x: frozenset, y: frozenset) -> frozenset:
    return _absorb({a | b for a in x for b in y})


def _grams(strings: set[str]) -> frozenset[frozenset[str]]:
    return _absorb({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _choices(op, arg) -> set[str] | None:
    """The strings that a single element stands for, lower-cased, or None if they are too many."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
        found = {chr(c).lower() for o, v in arg for c in (range(v[0], v[1] + 1) if o is sre.RANGE else [v])}
        return found if len(found) <= 8 else None
    return None


def _walk(items) -> tuple[frozenset, set[str] | None]:
    """The query of a sequence, and all strings that it stands for if these are few."""
    query, whole = TRUE, True
    now: set[str] = {""}

    def flush() -> None:
        nonlocal query, now, whole
        query, now, whole = _and(query, _grams(now)), {""}, False

    for op, arg in items:
        options, inner = _choices(op, arg), TRUE
        if op is sre.SUBPATTERN:
            inner, options = _walk(arg[3])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            inner = _absorb({q for p, _ in parts for q in p})
            options = set().union(*(o for _, o in parts)) if all(o is not None for _, o in parts) else None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            inner, options = _walk(sub)
            if high == 1 and options is not None:
                options, inner = options | {""}, TRUE
            elif not (low == high == 1):
                options, inner = None, inner if low else TRUE
        elif op is sre.AT:
            continue
        if options is None:
            flush()
            query = _and(query, inner)
        else:
            if len(now) * len(options) > MOST:
                flush()
            now = {a + b for a in now for b in options}
    if whole and len(now) <= MOST:
        return _and(query, _grams(now)), now
    return _and(query, _grams(now)), None


def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """A disjunction of trigram sets; ``TRUE`` if no trigram is mandatory."""
    return _walk(parser.parse(pattern))[0]


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that the rules' queries name."""
    return sorted({g for r in rules for q in trigram_query(r.pattern) for g in q})


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(``gram``, ``doc_id``): the position in ``grams`` of each that a document's lower-cased text holds."""
    low = docs.select("doc_id", F.lower("text").alias("_low")).where("_low is not null")
    has = [F.when(F.contains("_low", F.lit(g)), F.lit(k)) for k, g in enumerate(grams)]
    return low.select("doc_id", F.explode(F.array_compact(F.array(*has))).alias("gram")).select("gram", "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...], grams: list[str]) -> DataFrame:
    """(``doc_id``, ``rules``): a bit for each rule whose trigram query the document's postings meet."""
    width = 60
    words = range(-(-len(grams) // width))
    bit = [F.when(F.floor(F.col("gram") / width) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("gram") % width).cast("int"))).otherwise(F.lit(0).cast("long")) for w in words]
    one = index.groupBy("doc_id").agg(*(F.bit_or(b).alias(f"_m{w}") for w, b in zip(words, bit, strict=True)))
    at = {g: k for k, g in enumerate(grams)}

    def holds(query: frozenset[frozenset[str]]) -> Column:
        found = F.lit(False)
        for some in query:
            masks = [sum(1 << at[g] % width for g in some if at[g] // width == w) for w in words]
            ok = F.lit(True)
            for w, m in zip(words, masks, strict=True):
                if m:
                    ok = ok & (F.col(f"_m{w}").bitwiseAND(F.lit(m)) == F.lit(m))
            found = found | ok
        return found

    mask = F.lit(0).cast("long")
    for k, r in enumerate(rules):
        query = trigram_query(r.pattern)
        if query != TRUE:
            mask = mask + F.when(holds(query), F.lit(1 << k)).otherwise(F.lit(0))
    return one.select("doc_id", mask.alias("rules")).where("rules <> 0")


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind_no, end>> of a rule's matches, in code points, ends exclusive.

    Leftmost non-overlapping matches, the too short ones dropped.  A match's
    start is the length of all that splitting leaves before it.
    """
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.char_length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.char_length(x)).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.char_length(x)).alias("key"),
    )
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        one = F.struct(begin.alias("start"), F.lit(order).alias("kind_no"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["key"] >= rule.least, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

    # a list that grows is copied at each step, so it grows in runs of CHUNK, which are joined at the end
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(zipped) / CHUNK).cast("int")), lambda k: F.slice(zipped, k * CHUNK + 1, F.lit(CHUNK)))
    begin = F.struct(F.lit(0).alias("at"), none.alias("found"))
    fold = F.aggregate(runs, F.array(begin), lambda acc, run: F.concat(acc, F.array(F.aggregate(run, F.struct(F.element_at(acc, -1)["at"].alias("at"), none.alias("found")), step))))
    found = F.flatten(F.transform(fold, lambda x: x["found"]))
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(``doc_id``, ``found`` array<struct<start, kind_no, end>>) for every row; ``kind_no`` counts in ``rules``.

    Sorted by start, then kind.  A null text is empty.  Rows that share a
    ``doc_id`` share candidates, which only verifies more; null ids have
    postings like any other.  At most 62 rules.

    The candidate table is broadcast up to ``broadcast_bytes`` of ids and masks,
    summed first, and otherwise joined by shuffle.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    grams = vocabulary(rules)
    index = scratch.table(postings(docs, grams), "postings")
    some = scratch.table(candidates(index, rules, grams), "candidates").withColumnRenamed("doc_id", "_doc")
    if (some.agg(F.sum(F.octet_length(F.coalesce(F.col("_doc").cast("string"), F.lit(""))) + 24)).first()[0] or 0) <= broadcast_bytes:
        some = F.broadcast(some)
    rows = docs.join(some, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
    parts = []
    for k, r in enumerate(rules):
        found = spans(F.col("text"), r, k)
        if trigram_query(r.pattern) != TRUE:
            found = F.when(F.coalesce("rules", F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0, found).otherwise(none)
        parts.append(found)
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    names = F.array(*(F.lit(r.kind) for r in rules))

    def said(c: Column) -> Column:
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["kind_no"] + 1), x["start"], x["end"])), ",")

    count = lambda k: F.size(F.filter("found", lambda x: x["kind_no"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(said(F.filter("found", lambda x: x["kind_no"] < len(BASE))), 256).alias("base_sha256"),
        said(F.col("found")).alias("spans"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return report(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
