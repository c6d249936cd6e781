"""Scalar functions as column expressions: digests, HMAC, JSON text, identifiers, predicates and labels."""

from __future__ import annotations

import hashlib
import json
from itertools import groupby

from pyspark.sql import Column, functions as F

from ..config import DEFAULT, MAX_IDENTIFIER_BYTES, MAX_SAFE_INTEGER, LineageConfig


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def hmac_sha256(key: bytes, text: Column) -> Column:
    """Lower-case hex HMAC of the UTF-8 bytes of ``text``, from two built-in digests."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def json_string(*c: Column) -> Column:
    """JSON text of strings, joined by commas, nulls as such; see :func:`lower_escapes`."""
    return F.btrim(F.to_json(F.array(*c)), F.lit("[]"))  # what is next to the brackets is never one


def lower_escapes(text: Column) -> Column:
    """JSON text whose escapes of control characters are in lower case, as canonical text has them (``to_json`` writes them in upper case)."""
    low = text
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):  # an escape follows an even number of backslashes
        low = F.regexp_replace(low, rf"(?<!\\)((?:\\\\)*)\\u00{code:02X}", rf"$1\\u00{code:02x}")
    return F.when(text.rlike(r"\\u00[01][A-F]"), low).otherwise(text)


def json_array(*parts) -> Column:
    """A heterogeneous JSON array as text, without white space.

    Parts are literal strings, or ``("s", column)`` for a string, ``("n", column)``
    for a number or boolean and ``("a", column)`` for an array of strings.
    Strings that follow one another are written by one call.
    """
    made: list[Column] = []
    for kind, run in groupby(parts, lambda p: "" if isinstance(p, str) else p[0]):
        some = list(run)
        if kind == "":
            made.append(F.lit(",".join(json.dumps(p, ensure_ascii=False) for p in some)))
        elif kind == "s":
            made.append(json_string(*(c for _, c in some)))
        else:
            made += [F.coalesce(F.to_json(c) if kind == "a" else c.cast("string"), F.lit("null")) for _, c in some]
    return F.concat(F.lit("["), F.concat_ws(",", *made), F.lit("]"))


def canonical_json(text: Column) -> Column:
    """Keys sorted, no white space; null if it is no JSON.  Numbers are written as the variant type does."""
    return F.to_json(F.try_parse_json(text))


def id48(text: Column) -> Column:
    """The first 48 bits of the SHA-256 as a long."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def vertex_id(artifact_id: Column, cfg: LineageConfig = DEFAULT) -> Column:
    return id48(F.concat(F.lit(f"{cfg.prefix}:vertex:"), artifact_id))


def selector(artifact_id: Column, cfg: LineageConfig = DEFAULT) -> Column:
    return sha256_hex(F.concat(F.lit(f"{cfg.prefix}:selector:"), artifact_id))


def edge_id(child: Column, parent: Column, kind: Column, cfg: LineageConfig = DEFAULT) -> Column:
    return id48(F.concat(F.lit(f"{cfg.prefix}:edge:"), child, F.lit(":"), parent, F.lit(":"), kind))


def parent_set_hash(parents: Column) -> Column:
    """Digest of the sorted distinct parent ids as a JSON array."""
    return sha256_hex(F.to_json(F.array_sort(F.array_distinct(parents))))


def is_hex64(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-f0-9]{64}\z"), F.lit(False))


def is_identifier(c: Column) -> Column:
    """1 to 256 bytes of letters, digits and ``._:@/-``."""
    return F.coalesce((F.octet_length(c) <= MAX_IDENTIFIER_BYTES) & c.rlike(r"^[A-Za-z0-9._:@/-]+\z"), F.lit(False))


def is_artifact_id(c: Column) -> Column:
    """1 to 256 bytes of anything."""
    return F.coalesce(F.octet_length(c).between(1, MAX_IDENTIFIER_BYTES), F.lit(False))


def is_safe_integer(c: Column) -> Column:
    return F.coalesce(c.between(0, MAX_SAFE_INTEGER), F.lit(False))


def _kind(value: Column, path: str) -> Column:
    """The type that a variant has at a path, as the variant type names it."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def is_object(value: Column, path: str = "$") -> Column:
    return F.coalesce(_kind(value, path).startswith("OBJECT"), F.lit(False))


def json_text(value: Column, path: str) -> Column:
    """The string that a variant has at a path; null for anything else, however it might be written."""
    return F.when(_kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def json_integer(value: Column, path: str) -> Column:
    """The whole number from 0 to 2^53 - 1 that a variant has at a path, else null; ``1e3`` and ``5.0`` are whole."""
    d = F.when(_kind(value, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, path, "double"))
    return F.when((d == F.floor(d)) & d.between(0, MAX_SAFE_INTEGER), d.cast("bigint"))


def json_keys(value: Column, path: str = "$") -> Column:
    """Field names of the object that a variant has at a path, else null."""
    return F.when(is_object(value, path), F.json_object_keys(F.to_json(F.try_variant_get(value, path, "variant"))))


def unexpected_fields(raw_json: Column, allowed: tuple[str, ...]) -> Column:
    """Sorted field names of a JSON object that aren't allowed; null if it is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(raw_json), F.array(*map(F.lit, allowed))))


def missing_fields(raw_json: Column, required: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.json_object_keys(raw_json)))


def clock_text(millis: Column) -> Column:
    """``HH:MM:SS`` in UTC of epoch milliseconds; ``unknown`` if null or out of range."""
    day = F.pmod(F.floor(millis / 1000), F.lit(86400))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat_ws(":", two(F.floor(day / 3600)), two(F.floor(day % 3600 / 60)), two(day % 60))
    return F.when(is_safe_integer(millis), text).otherwise("unknown")


def media_type(header: Column) -> Column:
    return F.lower(F.trim(F.split_part(header, F.lit(";"), F.lit(1))))


def outcome_status(status: Column) -> Column:
    """PASS, BLOCK or NOT_REACHED of a result's status."""
    return F.when(status.isin("PASS", "ALLOW"), "PASS").when(status == "BLOCK", "BLOCK").otherwise("NOT_REACHED")


def status_kind(status: Column) -> Column:
    """How a status is coloured: pass, block or neutral, whatever its case."""
    s = F.upper(F.coalesce(status, F.lit("")))
    good = s.isin("PASS", "ALLOW", "READY", "RESOLVED", "VERIFIED", "EXECUTED", "COMPLETED") | s.startswith("PASS_") | s.startswith("ALLOW_")
    bad = s.isin("BLOCK", "FAIL", "UNRESOLVED", "STALE", "ERROR") | s.startswith("BLOCK_") | s.startswith("FAIL_") | s.startswith("ERROR_")
    return F.when(good, "pass").when(bad, "block").otherwise("neutral")


def status_label(status: Column, missing: str = "NOT RUN") -> Column:
    """How a status is shown: in capitals, underscores as spaces."""
    s = F.upper(F.coalesce(status, F.lit("")))
    return F.when(s == "", missing).otherwise(F.replace(s, F.lit("_"), F.lit(" ")))


def scenario_body(body: Column) -> Column:
    """Whether a request's body is an object of one known field within 256 bytes."""
    ok = (F.octet_length(body) <= 256) & (F.size(unexpected_fields(body, ("scenario",))) == 0) & (F.size(missing_fields(body, ("scenario",))) == 0)
    return F.coalesce(ok, F.lit(False))


def request_bytes(*fields: Column) -> Column:
    """Bytes of a request's JSON text."""
    return F.octet_length(F.to_json(F.struct(*fields)))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def counted(n: Column, word: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, word).otherwise(word + "s"))
