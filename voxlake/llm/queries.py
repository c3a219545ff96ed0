"""Queries of the text operators, and SQL for the same results where SQL can express it."""

from __future__ import annotations

from voxlake.llm import chat, decontaminate, katz, licenses, lines, mixing, negatives, pii, quality, records, repair, sharding, simhash

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_katz": katz.op3_katz,
    "op4_snapshot_collapse": chat.op4_snapshot_collapse,
    "op5_token_records": records.op5_token_records,
    "op6_hypergeometric_shards": sharding.op6_hypergeometric_shards,
    "op7_simhash": simhash.op7_simhash,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_line_dedup": lines.op11_line_dedup,
    "op12_structure_repair": repair.op12_structure_repair,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
ORACLE_SQL = {"op4_snapshot_collapse": chat.OP4_SQL, "op9_quality_rules": quality.OP9_SQL, "op11_line_dedup": lines.OP11_SQL, "op13_hard_negatives": negatives.OP13_SQL}
