"""The corpus operators' queries, and DuckDB SQL for those that SQL can express."""

from . import decontaminate, divergence, language, neighbours, ngram_join, packing, pii, reshard, secret_scan, spelling, substring_dedup, topk, url_rules

QUERIES = {
    f.__name__: f
    for f in (
        ngram_join.op1_ngram_jaccard_join,
        reshard.op2_min_cost_reshard,
        decontaminate.op3_simhash_decontamination,
        topk.op4_exact_top_k,
        substring_dedup.op5_fm_index_dedup,
        packing.op6_bin_completion_packing,
        pii.op7_boosted_pii,
        language.op8_ppm_language_id,
        secret_scan.op9_markov_secret_scan,
        url_rules.op10_url_rules,
        divergence.op11_source_divergence,
        spelling.op12_spelling_variants,
        neighbours.op13_vantage_point_neighbours,
    )
}
SQL = {
    "op1_ngram_jaccard_join": ngram_join.OP1_SQL,
    "op4_exact_top_k": topk.OP4_SQL,
    "op5_fm_index_dedup": substring_dedup.OP5_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
}
