"""The queries of this subpackage and the SQL of those that SQL can express."""

from siltbed.llm import decontaminate, line_dedup, line_quality, lm_score, mixing, piece_codec, ranked_search, simhash, suffix_dedup, text_runs, token_counts, url_rules, warc

QUERIES = {
    f.__name__: f
    for f in (
        warc.op1_warc_derivatives, url_rules.op2_url_rules, token_counts.op3_token_counts, suffix_dedup.op4_suffix_dedup, lm_score.op5_lm_score, line_quality.op6_line_quality,
        line_dedup.op7_line_dedup, simhash.op8_simhash_dedup, decontaminate.op9_benchmark_decontamination, mixing.op10_source_mix,
        piece_codec.op11_piece_codec, text_runs.op12_text_runs, ranked_search.op13_ranked_search,
    )
}
SQL = {
    "op2_url_rules": url_rules.OP2_SQL, "op6_line_quality": line_quality.OP6_SQL, "op9_benchmark_decontamination": decontaminate.OP9_SQL,
    "op3_token_counts": token_counts.OP3_SQL, "op13_ranked_search": ranked_search.OP13_SQL,
}
