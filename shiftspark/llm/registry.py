"""Queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from shiftspark.llm import clusters, codebooks, decontam, idfiles, linededup, packing, quality, rules, secrets, simhash, substring, toxicity, urlfilter

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_benchmark_decontamination": decontam.op3_benchmark_decontamination,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_token_id_files": idfiles.op5_token_id_files,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_url_filter": urlfilter.op10_url_filter,
    "op11_substring_dedup": substring.op11_substring_dedup,
    "op12_vector_codes": codebooks.op12_vector_codes,
    "op13_centroid_clusters": clusters.op13_centroid_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": linededup.OP2_SQL,
    "op11_substring_dedup": substring.OP11_SQL,
    "op12_vector_codes": codebooks.OP12_SQL,
    "op13_centroid_clusters": clusters.OP13_SQL,
}
