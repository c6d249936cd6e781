"""Stored schemas, in signature order."""

from __future__ import annotations

from pyspark.sql import types as T

_LONG = {"vertex_id", "edge_id", "child_vertex_id", "parent_vertex_id"}
_INT = {"generation", "parent_count", "write_version", "child_generation", "parent_generation"}

#: Field names and their order, which the tags cover.
NODE_FIELDS = (
    "vertex_id", "artifact_id", "selector", "role", "generation", "terminal", "content_hash", "trust_state", "auth_state",
    "writer_id", "writer_key_id", "gate_id", "parent_count", "parent_set_hash", "lineage_kind", "context_id", "batch_id",
    "write_version", "create_only", "authority_id", "authority_proof_hash",
)
EDGE_FIELDS = (
    "edge_id", "child_artifact_id", "parent_artifact_id", "kind", "child_generation", "parent_generation",
    "writer_id", "writer_key_id", "gate_id", "batch_id", "write_version",
)


def _field(name: str) -> T.StructField:
    kind = T.LongType() if name in _LONG else T.IntegerType() if name in _INT else T.BooleanType() if name == "terminal" else T.StringType()
    return T.StructField(name, kind)


ARTIFACTS = T.StructType([_field(n) for n in (*NODE_FIELDS, "auth_tag")])
EDGES = T.StructType([_field(n) for n in (*EDGE_FIELDS, "auth_tag", "child_vertex_id", "parent_vertex_id")])


def json_parts(names: tuple[str, ...]) -> list[tuple[str, str]]:
    """(kind, name) of each field, as ``functions.columns.json_array`` takes them."""
    return [("n" if n in _LONG | _INT or n == "terminal" else "s", n) for n in names]
