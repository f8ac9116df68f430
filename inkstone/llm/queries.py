"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, dedup, licenses, lines, merkle, mixing, packing, pii, quality, quoting, runs, sharding, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_minhash_near_dedup": dedup.op2_minhash_near_dedup,
    "op3_warc_roundtrip": warc.op3_warc_roundtrip,
    "op4_minimax_sharding": sharding.op4_minimax_sharding,
    "op5_quotation_linking": quoting.op5_quotation_linking,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_benchmark_decontamination": decontam.op8_benchmark_decontamination,
    "op9_personal_data": pii.op9_personal_data,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_source_mix": mixing.op12_source_mix,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": dedup.ORACLE_SQL,
    "op3_warc_roundtrip": warc.ORACLE_SQL,
    "op8_benchmark_decontamination": decontam.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
