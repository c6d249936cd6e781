"""The identifiers and digests as functions of SQL statements."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import DEFAULT, LineageConfig


def _hmac(key: bytes, text: str) -> str:
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    return f"sha2(concat(unhex('{outer}'), unhex(sha2(concat(unhex('{inner}'), encode({text}, 'UTF-8')), 256))), 256)"


def register(spark: SparkSession, cfg: LineageConfig = DEFAULT) -> None:
    """Define the temporary functions ``lineage_id48``, ``lineage_vertex_id``, ``lineage_selector``, ``lineage_edge_id``, ``lineage_hmac`` and ``lineage_connector_hmac``."""
    one = {
        "lineage_id48(t STRING) RETURNS BIGINT": "CAST(conv(substr(sha2(t, 256), 1, 12), 16, 10) AS BIGINT)",
        "lineage_vertex_id(a STRING) RETURNS BIGINT": f"CAST(conv(substr(sha2(concat('{cfg.prefix}:vertex:', a), 256), 1, 12), 16, 10) AS BIGINT)",
        "lineage_selector(a STRING) RETURNS STRING": f"sha2(concat('{cfg.prefix}:selector:', a), 256)",
        "lineage_edge_id(c STRING, p STRING, k STRING) RETURNS BIGINT": f"CAST(conv(substr(sha2(concat('{cfg.prefix}:edge:', c, ':', p, ':', k), 256), 1, 12), 16, 10) AS BIGINT)",
        "lineage_hmac(t STRING) RETURNS STRING": _hmac(cfg.signing_key, "t"),
        "lineage_connector_hmac(t STRING) RETURNS STRING": _hmac(cfg.connector_key, "t"),
    }
    for head, body in one.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
