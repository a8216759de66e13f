"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, exact, fingerprint, hosts, lines, minhash, mixing, quality, shards, toxicity

QUERIES = {
    "op1_shards": shards.query,
    "op2_quality": quality.query,
    "op3_mixing": mixing.query,
    "op4_bpe": bpe.query,
    "op5_toxicity": toxicity.query,
    "op6_minhash": minhash.query,
    "op7_lines": lines.query,
    "op8_exact": exact.query,
    "op9_fingerprint": fingerprint.query,
    "op10_hosts": hosts.query,
}

ORACLES = {
    "op3_mixing": mixing.ORACLE_SQL,
    "op7_lines": lines.ORACLE_SQL,
    "op8_exact": exact.ORACLE_SQL,
    "op10_hosts": hosts.ORACLE_SQL,
}
