"""A plain model of a signed lineage graph, for tests: digests by hashlib and a depth-first closure."""

import hashlib
import hmac
import json


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tag(key, fields):
    return hmac.new(key, json.dumps(fields, separators=(",", ":"), ensure_ascii=False).encode(), hashlib.sha256).hexdigest()


def id48(text):
    return int(sha(text)[:12], 16)


def closure(parents, terminal, bad_nodes, root, depth_cap, node_cap=10**9):
    """(classification, nodes, edges, sources, longest) of a root, level by level over every path."""
    longest, level = {}, {root}
    for d in range(depth_cap + 1):
        longest |= dict.fromkeys(level, d)
        if len(longest) > node_cap:
            return ("UNRESOLVED",)
        faults = []
        for n in sorted(level):
            if n in bad_nodes:
                faults.append("INVALID")
            elif not terminal(n) and d >= depth_cap:
                faults.append("UNRESOLVED")
            elif any(p in bad_nodes for p in parents[n]):
                faults.append("INVALID")
        if faults:
            return (faults[0],)
        level = {p for n in level for p in parents[n]}
        if not level:
            break
    return "VERIFIED", len(longest), sum(len(parents[n]) for n in longest if not terminal(n)), sum(terminal(n) for n in longest), max(longest.values())
