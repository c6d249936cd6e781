"""Language ID by error-correcting output codes over binary n-gram classifiers.

Each learned language has a codeword.  For each bit a binary naive Bayes
classifier over hashed character bigrams and trigrams tells the languages with
that bit from those without it; its margin is the mean log odds of a text's
n-grams.  Decoding is loss-weighted: a language's distance is the sum over bits
of the logistic loss of its code against the margins, each bit weighted by how
well it does on that language in the sample.  The nearest codeword wins, and a
text is ambiguous if the second one is nearly as near.

Models are fitted on a bounded sample: about ``sample_docs`` whole texts in all,
an equal share a language, chosen by a hash of the document (a documented
bound; the shares follow from counts over all documents).  Texts of the sample
never reach the driver: it gets n-gram counts, at most ``most_langs`` x
``BINS``.  Of more values of ``lang`` the most frequent ones are learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Scratch, freeing, packed, ship, unpacked

BINS = 1 << 16
SLICE = 1 << 18  # n-grams whose weights are gathered at once
_letters: np.ndarray | None = None


def _folded(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of what isn't a letter as one space, one at either end."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    c[~_letters[c]] = 32
    return c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]


def ngrams(text: str | None) -> np.ndarray:
    """Bins of all bigrams and trigrams of a whole text; none if it has no letter."""
    c = _folded(text or "")
    if len(c) < 3:
        return np.empty(0, np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
    return np.concatenate([two, three]) >> np.uint32(16)


def codewords(n: int) -> np.ndarray:
    """Codes of +1 and -1, a row a language: exhaustive to 7 languages, else the best of seeded random ones."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        bits = (1 << n - 1) - 1
        return np.array([[1 if i == 0 or k >> (i - 1) & 1 else -1 for k in range(bits)] for i in range(n)], np.int8)
    bits, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(7), None
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        same = code.astype(int) @ code.T
        apart = (code.shape[1] - same[~np.eye(n, dtype=bool)].max()) / 2
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


class Model:
    """``weights`` (bins x bits) of all classifiers, ``code`` (languages x bits) and how far to trust each bit for each language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1]) if len(langs) else counts
        one, zero = (self.code > 0).astype(float), (self.code < 0).astype(float)
        self.weights = np.zeros((BINS, self.code.shape[1]), np.float32)
        if len(langs) > 1:
            p = (one / one.sum(axis=0)).T @ share
            q = (zero / zero.sum(axis=0)).T @ share
            self.weights = np.ascontiguousarray(np.log(p / q).T, np.float32)
        self.trust = np.full(self.code.shape, 1 / max(1, self.code.shape[1]))

    def margins(self, text: str | None) -> np.ndarray | None:
        """A margin a bit; None without a letter."""
        bins = ngrams(text)
        if not len(bins):
            return None
        total = np.zeros(self.weights.shape[1])
        for k in range(0, len(bins), SLICE):
            total += self.weights[bins[k : k + SLICE]].sum(axis=0, dtype=np.float64)
        return total / len(bins)

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Language, score in 0..1 and whether the text is ambiguous."""
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        far = (np.logaddexp(0, -4 * self.code * margins) * self.trust).sum(axis=1)
        order = np.argsort(far, kind="stable")
        like = np.exp((far[order[0]] - far) * 8)
        near, second = far[order[0]], far[order[1]]
        return self.langs[order[0]], float(1 / like.sum()), bool(second - near < 0.05 * second)


def held_out(doc_id):
    """True where the crc32 of the id as text leaves no remainder by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, scratch: Scratch, sample_docs: int = 2400, most_langs: int = 200) -> Model:
    """Learn from ``text`` and non-null ``lang`` of the documents that are not held out."""
    ship(docs.sparkSession)
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, BINS)))
    each = max(50, sample_docs // len(langs))
    at = F.create_map(*(x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, each / sizes[lang])))))[F.col("lang")]
    chance = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = scratch.table(known.where(F.coalesce(chance < at, F.lit(False))).select("text", "lang"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                total.setdefault(lang, np.zeros(BINS, np.int64))
                total[lang] += np.bincount(ngrams(text), minlength=BINS)
        for lang, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(some), "bin": pa.array(some.astype(np.int32)), "n": pa.array(n[some])})

    counts = np.zeros((len(langs), BINS))
    place = {lang: k for k, lang in enumerate(langs)}
    found = sample.mapInArrow(freeing(count), "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    where = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    counts[where, found.column("bin").to_numpy()] = found.column("n").to_numpy()
    model = Model(langs, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        right, n = np.zeros(m.code.shape, np.int64), np.zeros(len(m.langs), np.int64)
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if (f := m.margins(text)) is not None:
                    right[place[lang]] += np.sign(f) == m.code[place[lang]]
                    n[place[lang]] += 1
        i, s = np.nonzero(np.ones_like(right))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(s), pa.array(right[i, s]), pa.array(n[i])], ["i", "s", "ok", "n"])

    trust = np.zeros(model.code.shape)
    for r in sample.mapInArrow(freeing(judge), "i bigint, s bigint, ok bigint, n bigint").groupBy("i", "s").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")).collect():
        trust[r.i, r.s] = (r.ok + 1) / (r.n + 2)
    model.trust = trust / trust.sum(axis=1, keepdims=True) if trust.all() else model.trust
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(``doc_id``, ``lang_pred``, ``score``, ``ambiguous``) for every row, from the whole text alone.

    ``und``, score 0 and not ambiguous if the text is null or has no letter, or
    nothing was learned.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rows = []
            for t in b.column("text"):
                f = m.margins(t.as_py()) if m.langs else None
                rows.append(("und", 0.0, False) if f is None else m.decode(f))
            lang, score, doubt = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(freeing(run), f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text has a language: neither ``und`` nor ambiguous; all columns stay."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for j in range(0, b.num_rows, 1024):
                part = b.slice(j, 1024)
                margins = [m.margins(t.as_py()) if m.langs else None for t in part.column("text")]
                yield part.filter(pa.array([f is not None and not m.decode(f)[2] for f in margins], pa.bool_()))

    rows = packed(docs, "text")
    return unpacked(rows.mapInArrow(freeing(run), rows.schema), docs.columns, ("text",))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, Scratch(spark, "language"))
    found = predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
