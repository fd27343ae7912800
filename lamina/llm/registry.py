"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import ann, decontaminate, html, licenses, linededup, neardup, packing, pii, sharding, toxicity

QUERIES: dict = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_shard": sharding.op3_shard,
    "op4_extract": html.op4_extract,
    "op5_licenses": licenses.op5_licenses,
    "op6_pack": packing.op6_pack,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_near_dedup": neardup.op8_near_dedup,
    "op9_ann": ann.op9_ann,
    "op10_pii": pii.op10_pii,
}

ORACLES: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op7_line_dedup": linededup.ORACLE,
    "op8_near_dedup": neardup.ORACLE,
}
