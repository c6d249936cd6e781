"""Settings and fixed values of the lineage model."""

from __future__ import annotations

from dataclasses import dataclass

#: Roles, kinds and limits of the data model.
DERIVED_ROLES = ("claim", "summary", "action_argument")
EDGE_KINDS = ("assert", "summarize", "support", "require")
SOURCE_TRUST = ("trusted_source", "untrusted_source")
DATA_CLASSES = ("public", "internal", "restricted")
MAX_PARENTS = 64
MAX_IDENTIFIER_BYTES = 256
MAX_SAFE_INTEGER = 9007199254740991
INTENT_FIELDS = ("action_id", "subject_id", "action_type", "parameters", "request_id", "requested_at", "provenance_artifact_id")
PARAMETER_FIELDS = ("data_class", "destination", "payload")
PRODUCER_FIELDS = ("content",)
SOURCE_FIELDS = ("attestation", "content", "id")
ATTESTATION_FIELDS = ("issuer", "key_id", "signature")
SENDING = "send_message"
MAX_JSON_DEPTH = 8
MAX_JSON_ITEMS = 64
MAX_JSON_FIELDS = 32
MAX_PAYLOAD_BYTES = 4096
MAX_PARAMETER_BYTES = 8192
MAX_CONTENT_BYTES = 1_000_000


@dataclass(frozen=True)
class LineageConfig:
    """Names, keys, allowlists and bounds; keys appear in query plans, so real ones belong in a signing job of their own."""

    prefix: str = "lineage"
    writer_id: str = "lineage-writer-v1"
    writer_key_id: str = "local-writer-key-v1"
    gate_id: str = "lineage-gate-v1"
    create_only: str = "lineage-create-only-v1"
    signing_key: bytes = b"a-signing-key-for-tests-and-benches-only"
    connector_key: bytes = b"a-connector-key-for-tests-and-benches-only"
    connector_issuer: str = "registry"
    connector_key_id: str = "connector-key-v1"
    verifier_version: str = "lineage-state-verifier-v1"
    gateway_version: str = "lineage-gateway-v1"
    contract_version: str = "lineage-trusted-state-v1"
    policy_version: str = "lineage-policy-v1"
    allowed_authorities: tuple[str, ...] = ("registry",)
    allowed_destinations: tuple[str, ...] = ("internal:alerts",)
    action_types: tuple[str, ...] = (SENDING,)
    min_trusted_sources: int = 1
    max_freshness_ms: int = 5000
    max_ancestry_depth: int = 16
    max_generation: int = 64
    max_closure_nodes: int = 1024
    max_ledger_entries: int = 10_000

    def __post_init__(self):
        if len(self.signing_key) < 32:
            raise ValueError("the signing key needs 32 bytes or more")
        for name, low, high in (("min_trusted_sources", 1, 16), ("max_freshness_ms", 1, 300_000), ("max_ancestry_depth", 1, 64), ("max_generation", 1, 1000), ("max_closure_nodes", 1, 100_000), ("max_ledger_entries", 1, 100_000)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie in {low}..{high}")


DEFAULT = LineageConfig()
