import base64
import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import tiktoken
import xxhash
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lineaspark.llm import byte_bpe, pieces, simple8b
from lineaspark.llm.shared import Scratch

SCHEMA = "doc_id bigint, text string, ids string, start int, n_tokens string"
ODD = ["", None, " ", "\n\n  x", "a  b   c\t d", "it's .,. don't.", "<|endoftext|> x<|startoftext|>.", "\x1c.a\x1d b", "İ. İ, ÑŸ.", "é.è, ﬁ Å Å ́x", "😀👍🏽 ‍", "x" * 30_000, "日本語。テスト", "\u0085 a b", "1,000.50", "A.B,C...d"]


def texts():
    rng = random.Random(4)
    bits = ["the", " ", "  ", "\n", ".", ",", "É", "token", "'s", "'ll", "12", "é", "😀", "\t", " ", "\x1e", "<|endoftext|>", "Zz", "…", "\r\n", "ing"]
    return ODD + ["".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(300)]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_whole_texts():
    both = texts()
    own, known = pieces.PieceEncoder(byte_bpe.vocabulary(), True, limit=50), reference()
    for t, ids in zip(both, own.encode(both), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(t or ""), repr(t)
    own, known = pieces.PieceEncoder(simple8b.vocabulary(), False, limit=50), Tokenizer.from_file(simple8b.vocabulary())
    for t, ids in zip(both, own.encode(both), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_every_letter_mark_and_number_before_a_stop():
    some = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LMN"]
    both = [t for c in some for t in (f"a{c}. {c}, X{c}.{c}", f"{c}'S{c}{c.upper()}1,")]
    for path, own in ((byte_bpe.vocabulary(), True), (simple8b.vocabulary(), False)):
        mine, library = pieces.PieceEncoder(path, own), Tokenizer.from_file(path)
        library.encode_special_tokens = own
        for k in range(0, len(both), 20_000):
            part = both[k : k + 20_000]
            for t, ids, e in zip(part, mine.encode(part), library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == e.ids, ascii(t)


def test_a_small_table_keeps_what_is_met_again():
    own = pieces.PieceEncoder(simple8b.vocabulary(), False, limit=40)
    library = Tokenizer.from_file(simple8b.vocabulary())
    words = lambda: {"".join(map(chr, own.table.chars.take(np.array([k]))[0])) for k in range(len(own.table.hashes))}
    for k in range(60):
        text = f"common common w{k}a w{k}b w{k}c w{k}d " + "z" * 100
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert "common" in words() and len(words()) <= 45
    assert len({w for w in words() if len(w) > pieces.SHORT}) <= 1


def test_pretokens_of_one_hash_are_told_apart():
    own, library = pieces.PieceEncoder(byte_bpe.vocabulary(), True), Tokenizer.from_file(byte_bpe.vocabulary())
    own.encode(["abc"])
    table = own.table
    table.chars.data[:3] = [ord(x) for x in "xyz"]  # as if another pre-token had its hash
    assert np.frombuffer(own.encode(["abc"])[0], "<u4").tolist() == library.encode("abc", add_special_tokens=False).ids


def test_long_texts_are_cut_before_white_space():
    rng = random.Random(9)
    text = "".join(rng.choices(["word", " ", "  ", "\n", "it's", "don't ", "9", "--", "\u00e9t\u00e9", "\u65e5 "], k=200_000))
    for path, special in ((byte_bpe.vocabulary(), True), (simple8b.vocabulary(), False)):
        own, library = pieces.PieceEncoder(path, special), Tokenizer.from_file(path)
        for t in (text, text.replace("\u65e5", ""), "x" * 600_000 + " a", text[:1000] * 300):
            assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_round_trip_query(spark):
    rows = [(k, t, "i", 0, "n") for k, t in enumerate(texts())] + [(1, "again", "", 0, ""), (None, "x", "", 0, "")]
    got = sorted(map(tuple, byte_bpe.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    known = reference()
    want = []
    for i, t, *_ in rows:
        ids = known.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_offsets_and_decoding(spark):
    rows = [(k, t, "", 0, "") for k, t in enumerate(texts())]
    tokens = byte_bpe.encode(spark.createDataFrame(rows, SCHEMA))
    library = Tokenizer.from_file(byte_bpe.vocabulary())
    library.encode_special_tokens = True
    table = byte_bpe.table(byte_bpe.vocabulary())
    for r in tokens.collect():
        text = rows[r.doc_id][1] or ""
        e = library.encode(text, add_special_tokens=False)
        assert r.ids == e.ids
        for i, a, b, (x, y) in zip(r.ids, r.starts, r.ends, e.offsets, strict=True):
            part = table.decode(np.array([i]))
            assert (a, b) == (x, y) and part in text[a:b].encode()
    assert {r.doc_id: r.text for r in byte_bpe.decode(tokens).collect()} == {i: t or "" for i, t, *_ in rows}
    ids = np.frombuffer(pieces.encoder(byte_bpe.vocabulary(), True).encode(["😀"])[0], "<u4")
    assert len(ids) > 1 and table.text(ids[:1]) == "�" and table.text(ids) == "😀"


def test_vocabularies_agree():
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    table = byte_bpe.table(byte_bpe.vocabulary())
    assert all(table.decode(np.array([i])) == b for i, b in ranks.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, (1 << 64) - 1), st.just((1 << 64) - 1)), max_size=900))
def test_words_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, starts = simple8b.pack(ids)
    assert (simple8b.unpack(words, starts, len(ids)) == ids).all()
    for k in range(len(starts) - 1):  # each block on its own
        n = min(simple8b.BLOCK, len(ids) - k * simple8b.BLOCK)
        part = simple8b.unpack(words[starts[k] : starts[k + 1]], starts[k : k + 2] - starts[k], n)
        assert (part == ids[k * simple8b.BLOCK :][:n]).all()


def test_files_hold_all_ids_in_order(spark):
    rows = [(k, t, "", 0, "") for k, t in enumerate(texts())]
    rows = [(1000 - i, *r) for i, *r in rows] + [(None, "nobody", "", 0, ""), (990, "twice", "", 0, ""), (-5, None, "", 0, "")]
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    known = Tokenizer.from_file(simple8b.vocabulary())
    digest = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0], digest(r[1])))
    want, start = [], 0
    for i, t, *_ in order:
        ids = np.array(known.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    for k, most in enumerate((1 << 24, 700)):
        manifest = scratch.table(simple8b.write(df, f"{scratch.base}/ids{k}", file_ids=most), f"m{k}")
        assert sorted(map(tuple, simple8b.read(manifest).collect()), key=lambda r: r[1]) == want
    none = scratch.table(simple8b.write(spark.createDataFrame([], SCHEMA), f"{scratch.base}/none"), "none")
    assert simple8b.read(none).collect() == []
