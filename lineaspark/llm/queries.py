"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, decontaminate, divergence, hilbert, language_id, line_dedup, media, minhash, secrets, simhash, simple8b, unit_dedup, vector_codes


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1,
        "op2_unit_dedup": unit_dedup.op2,
        "op3_line_dedup": line_dedup.op3,
        "op4_secret_scan": secrets.op4,
        "op5_byte_bpe": byte_bpe.op5,
        "op6_hilbert_shards": hilbert.op6,
        "op7_simhash_near_dedup": simhash.op7,
        "op8_media_columns": media.op8,
        "op9_decontamination": decontaminate.op9,
        "op10_simple8b": simple8b.op10,
        "op11_source_divergence": divergence.op11,
        "op12_vector_codes": vector_codes.op12,
        "op13_minhash_near_dedup": minhash.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.SQL,
        "op9_decontamination": decontaminate.SQL,
        "op11_source_divergence": divergence.SQL,
        "op12_vector_codes": vector_codes.SQL,
        "op13_minhash_near_dedup": minhash.SQL,
    }
