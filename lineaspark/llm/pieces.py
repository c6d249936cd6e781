"""Exact encoding with the tokenizers library, one call for each distinct pre-token.

A byte-pair model sees a text only as its pre-tokens, so the ids of a text are
those of its pre-tokens in order.  Pre-tokens repeat, far more than words with
their punctuation do, so each worker keeps the ids of those it has met in a
bounded table and asks the library's model for new ones only.

Texts of the characters in ``_KNOWN`` are cut here, for many texts at once and
by the vocabulary's own pattern: none of these characters changes under NFC,
each is lower-cased to one of them, and which are letters, numbers and white
space is fixed.  Pre-tokens are found in the table by a hash, and then compared
character by character.  Any other text is cut before its white space, which
no pre-token crosses, and of its parts those with another character (or with
the string of a special token) go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from .shingles import mix, powers

#: White space of the library's patterns, below U+0180 and beyond.
_SPACE = r"\t-\r \x85\xa0"
_WIDE = r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers below U+0180; the other characters of ``_KNOWN`` are signs.
_LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: U+0130 is left out, since its lower case is two characters; beyond are dashes, quotation marks and such, and the euro sign.
_KNOWN = r"\x00-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20ac"
_BETWEEN = "\u20ff"  # not among them: stands between texts that are worked together
_PART = re.compile(f"[{_SPACE}{_WIDE}]*[^{_SPACE}{_WIDE}]+|[{_SPACE}{_WIDE}]+")
_EDGE = re.compile(f"(?<=[^{_SPACE}{_WIDE}])[{_SPACE}{_WIDE}]")
SPACE, LETTER, NUMBER, SIGN, BETWEEN = range(5)
GROUP = 1 << 18  # characters that are worked together
SHORT = 64  # longer pre-tokens go when the table is cut back


def _kinds() -> np.ndarray:
    kinds = np.full(ord(_BETWEEN) + 1, SIGN, np.uint8)
    every = "".join(map(chr, range(0x180)))
    for kind, some in ((SPACE, _SPACE), (LETTER, _LETTER), (NUMBER, _NUMBER)):
        kinds[[ord(c) for c in re.findall(f"[{some}]", every)]] = kind
    kinds[-1] = BETWEEN
    return kinds


_KINDS = _kinds()
_POWERS = powers(2 * GROUP)


def byte_characters() -> list[str]:
    """The character that stands for each of the 256 bytes: printable Latin-1 for itself, the others from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class _Flat:
    """Runs of integers, one after another in one array."""

    def __init__(self, kind):
        self.data = np.empty(1 << 12, kind)
        self.ends = np.zeros(1, np.int64)

    def add(self, data: np.ndarray, ends: np.ndarray) -> None:
        """Runs joined in ``data``, and where each ends."""
        at = int(self.ends[-1])
        if at + len(data) > len(self.data):
            self.data = np.concatenate([self.data, np.empty(max(len(self.data) // 2, len(data)), self.data.dtype)])
        self.data[at : at + len(data)] = data
        self.ends = np.concatenate([self.ends, at + ends])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of ``rows``, joined, and where each ends."""
        first, n = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        ends = np.cumsum(n)
        return self.data[np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends

    def keep(self, rows: np.ndarray) -> None:
        data, ends = self.take(rows)
        self.data, self.ends = data, np.concatenate([np.zeros(1, np.int64), ends])


class Table:
    """Pre-tokens that were met: hash, characters, ids and how often; open addressing over at least twice as many places."""

    def __init__(self, limit: int):
        self.limit = max(4, limit)
        self.mask = np.uint64((1 << (2 * self.limit - 1).bit_length()) - 1)
        self.hashes, self.met = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.chars, self.ids = _Flat(np.uint16), _Flat(np.uint32)
        self._place()

    def _place(self) -> None:
        self.at = np.full(int(self.mask) + 1, -1, np.int32)
        self._insert(np.arange(len(self.hashes)))

    def _insert(self, rows: np.ndarray) -> None:
        place = self.hashes[rows] & self.mask
        while len(rows):
            free = self.at[place] < 0
            self.at[place[free]] = rows[free]  # of rows that want one place, one gets it
            left = self.at[place] != rows
            rows, place = rows[left], (place[left] + np.uint64(1)) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        rest, place = np.arange(len(hashes)), hashes & self.mask
        while len(rest):
            row = self.at[place]
            some = row >= 0
            same = some & (self.hashes[row] == hashes[rest]) if len(self.hashes) else some
            out[rest[same]] = row[same]
            go = some & ~same
            rest, place = rest[go], (place[go] + np.uint64(1)) & self.mask
        return out

    def add(self, hashes: np.ndarray, chars: tuple[np.ndarray, np.ndarray], ids: tuple[np.ndarray, np.ndarray]) -> None:
        if len(hashes):
            n = len(self.hashes)
            if n + len(hashes) > int(self.mask) * 3 // 4:  # one group has more new ones than the table was made for
                self.mask = np.uint64((1 << (2 * (n + len(hashes))).bit_length()) - 1)
                self._place()
            self.hashes, self.met = np.concatenate([self.hashes, hashes]), np.concatenate([self.met, np.zeros(len(hashes), np.int64)])
            self.chars.add(*chars)
            self.ids.add(*ids)
            self._insert(np.arange(n, n + len(hashes)))

    def trim(self) -> None:
        """Past the limit (or 16 characters for each), the half that was met most often stays, and counts are halved, so that they follow the text."""
        if len(self.hashes) <= self.limit and self.chars.ends[-1] <= 16 * self.limit + (1 << 16):
            return
        most = np.where(np.diff(self.chars.ends) <= SHORT, self.met, -1)
        rows = np.argsort(-most, kind="stable")[: self.limit // 2]
        rows = np.sort(rows[most[rows] >= 0])
        self.hashes, self.met = self.hashes[rows], self.met[rows] // 2
        self.chars.keep(rows)
        self.ids.keep(rows)
        self._place()


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers; ``limit`` bounds the table of pre-tokens."""

    def __init__(self, path: str, specials_as_text: bool, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.model = self.tokenizer.model
        self.folds = self.tokenizer.normalizer is not None  # NFC, lower case; white space is dropped, and numbers are cut to digits
        special = [] if specials_as_text else [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.other = re.compile("|".join([f"[^{_KNOWN}]", *special]))
        self.bytes = str.maketrans(dict(enumerate(byte_characters())))
        self.table = Table(limit)

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """The text in pieces cut before white space: whether the library must see the piece, and the piece."""
        at = 0
        while len(text) - at > GROUP and (m := _EDGE.search(text, at + GROUP)):
            yield from self._checked(text[at : m.start()])
            at = m.start()
        yield from self._checked(text[at:])

    def _checked(self, text: str) -> Iterator[tuple[bool, str]]:
        if not self.other.search(text):
            yield False, text
            return
        held: list[str] = []
        for part in _PART.findall(text):
            if not self.other.search(part):
                held.append(part)
                continue
            if held:
                yield False, "".join(held)
                held = []
            yield True, part
        if held:
            yield False, "".join(held)

    def pretokens(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last place of every pre-token of known characters (as code points)."""
        kind = _KINDS[c]
        new = np.ones(len(c), bool)
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= kind == (NUMBER if self.folds else BETWEEN)
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(c))
        kind = kind[start]
        extra = np.empty(0, np.int64)
        if not self.folds:  # the last of several spaces stands apart, and goes with what follows if it is U+0020
            led = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != BETWEEN))
            blank = c[end[led] - 1] == 32
            start[led[blank] + 1] -= 1
            extra = end[led[~blank & (end[led] - start[led] > 1)]] - 1
            end[led[blank | (end[led] - start[led] > 1)]] -= 1
        # an apostrophe by itself takes s, t, m, d, re, ve or ll from the letters behind it
        own = np.flatnonzero((kind[:-1] == SIGN) & (end[:-1] - start[:-1] == 1) & (kind[1:] == LETTER))
        own = own[(c[start[own]] == ord("'")) & (start[own + 1] == end[own])]
        one, two = c[end[own]], c[np.minimum(end[own] + 1, len(c) - 1)]
        pair = (end[own + 1] - start[own + 1] > 1) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        taken = np.where(np.isin(one, [ord(x) for x in "stmd"]), 1, 2 * pair)
        end[own] += taken
        start[own + 1] += taken
        keep = (end > start) & (kind != BETWEEN)
        if self.folds:
            keep &= kind != SPACE
        start, end = start[keep], end[keep]
        if len(extra):
            start, end = np.concatenate([start, extra]), np.concatenate([end, extra + 1])
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
        return start, end

    def _group(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of known characters."""
        joined = _BETWEEN.join(texts)
        if self.folds:
            joined = joined.lower()
        c = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        if not len(c):
            return [b""] * len(texts)
        start, end = self.pretokens(c)
        up, down = _POWERS if len(c) < len(_POWERS[0]) else powers(len(c))
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum((c + np.uint64(1)) * up[: len(c)], out=total[1:])
        hashes = mix((total[end] - total[start]) * down[start])
        row = self.table.find(hashes)
        lost = np.flatnonzero(row < 0)
        if len(lost):
            new, first = np.unique(hashes[lost], return_index=True)
            begin, past = start[lost[first]], end[lost[first]]
            chars = np.cumsum(past - begin)
            at = np.repeat(begin - (chars - (past - begin)), past - begin) + np.arange(chars[-1])
            made: list[int] = []
            ends: list[int] = []
            for a, b in zip(begin.tolist(), past.tolist(), strict=True):
                made += [t.id for t in self.model.tokenize(joined[a:b].encode().decode("latin-1").translate(self.bytes))]
                ends.append(len(made))
            self.table.add(new, (c[at], chars), (np.array(made, np.uint32), np.array(ends)))
            row[lost] = self.table.find(hashes[lost])
        # pre-tokens cover, in order, all characters but those between texts (and white space, if that is dropped)
        chars, _ = self.table.chars.take(row)
        kind = _KINDS[c]
        if not np.array_equal(chars, c[(kind != BETWEEN) & (kind != SPACE)] if self.folds else c[kind != BETWEEN]):
            return self._whole(texts)  # two pre-tokens of one hash
        np.add.at(self.table.met, row, 1)
        ids, ends = self.table.ids.take(row)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        cuts = np.concatenate([np.zeros(1, np.int64), ends])[np.searchsorted(start, begins)].tolist()
        self.table.trim()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        out: list[list[bytes]] = [[] for _ in texts]
        known: list[tuple[int, int, str]] = []
        other: list[tuple[int, int, str]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            for some, make in ((known, self._group), (other, self._whole)):
                for (i, k, _), ids in zip(some, make([t for _, _, t in some]) if some else [], strict=True):
                    out[i][k] = ids
                some.clear()
            held = 0

        for i, text in enumerate(texts):
            for foreign, piece in self.segments(text or ""):
                (other if foreign else known).append((i, len(out[i]), piece))
                out[i].append(b"")
                held += len(piece) + 1
                if held >= GROUP:
                    flush()
        flush()
        return [b"".join(x) for x in out]


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, specials_as_text: bool, limit: int = 400_000) -> PieceEncoder:
    """The worker's encoder of a vocabulary file; it outlives a task."""
    key = (path, specials_as_text, limit)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, specials_as_text, limit)
    return _encoders[key]
