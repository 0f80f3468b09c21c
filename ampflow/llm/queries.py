"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from ampflow.llm import ann, bpe, html, language, licenses, lines, packing, quality, runs, secrets, sharding, simhash, whitening

QUERIES = {
    "op1_line_crf_quality": quality.op1,
    "op2_segment_grid_simhash": simhash.op2,
    "op3_layout_html_text": html.op3,
    "op4_sum_of_squares_packing": packing.op4,
    "op5_ivf_pq_neighbours": ann.op5,
    "op6_host_line_frequency": lines.op6,
    "op7_word_crf_language": language.op7,
    "op8_nested_secret_scan": secrets.op8,
    "op9_merge_replay_bpe": bpe.op9,
    "op10_sentence_rule_licenses": licenses.op10,
    "op11_householder_whitening": whitening.op11,
    "op12_suffix_array_runs": runs.op12,
    "op13_minimax_shards": sharding.op13,
}

#: The other operators train models, decode or pack in order; SQL cannot express them.
ORACLES: dict[str, str] = {"op10_sentence_rule_licenses": licenses.SQL}
