"""Queries of the training-data operators and their DuckDB oracles."""

from zonelens.llm import collocations, exact_dedup, merkle, mixing, url_filter, warc
from zonelens.llm.decontaminate import op3_rare_seeds
from zonelens.llm.html_extract import op7_tree_scoring
from zonelens.llm.language_id import op2_ppm
from zonelens.llm.ngram_join import op8_token_groups
from zonelens.llm.suffix_dedup import op1_prefix_free_parsing
from zonelens.llm.token_files import op12_perfect_hash
from zonelens.llm.toxicity import op5_crf

QUERIES = {
    "op1_prefix_free_parsing": op1_prefix_free_parsing,
    "op2_ppm": op2_ppm,
    "op3_rare_seeds": op3_rare_seeds,
    "op4_water_filling": mixing.op4_water_filling,
    "op5_crf": op5_crf,
    "op6_content_sort": exact_dedup.op6_content_sort,
    "op7_tree_scoring": op7_tree_scoring,
    "op8_token_groups": op8_token_groups,
    "op9_warc_ranges": warc.op9_warc_ranges,
    "op10_url_trie": url_filter.op10_url_trie,
    "op11_merkle_climb": merkle.op11_merkle_climb,
    "op12_perfect_hash": op12_perfect_hash,
    "op13_branch_and_bound": collocations.op13_branch_and_bound,
}

ORACLES = {
    "op4_water_filling": mixing.OP4_SQL,
    "op6_content_sort": exact_dedup.OP6_SQL,
    "op9_warc_ranges": warc.OP9_SQL,
    "op10_url_trie": url_filter.OP10_SQL,
    "op11_merkle_climb": merkle.OP11_SQL,
    "op13_branch_and_bound": collocations.OP13_SQL,
}
