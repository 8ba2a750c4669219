"""Queries of the training-data operators, and their SQL where SQL can express them."""

from . import bpe_transducer, crf_language, elkan_clusters, importance_resampling, line_dedup, metric_join, packing, rule_ensemble, simhash_dedup, suffix_dedup, token_counts, toxicity, vp_search

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_vp_search": vp_search.op2_vp_search,
    "op3_packing": packing.op3_packing,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_simhash_dedup": simhash_dedup.op5_simhash_dedup,
    "op6_bpe_transducer": bpe_transducer.op6_bpe_transducer,
    "op7_metric_join": metric_join.op7_metric_join,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_rule_ensemble": rule_ensemble.op10_rule_ensemble,
    "op11_crf_language": crf_language.op11_crf_language,
    "op12_elkan_clusters": elkan_clusters.op12_elkan_clusters,
    "op13_importance_resampling": importance_resampling.op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {"op12_elkan_clusters": elkan_clusters.OP12_SQL, "op13_importance_resampling": importance_resampling.OP13_SQL}
