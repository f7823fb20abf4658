"""The dealt operators' queries and their SQL."""

from __future__ import annotations

from . import bpe, chat, media, middle, neardup, packing, pii, quality, token_files, toxicity, url_filter, variants, warc

QUERIES = {
    "op1_temporal_url_lists": url_filter.op1_temporal_url_lists,
    "op2_risk_controlled_rules": quality.op2_risk_controlled_rules,
    "op3_bpe_segment_tree": bpe.op3_bpe_segment_tree,
    "op4_interleaved_media": media.op4_interleaved_media,
    "interleave_pages": media.interleave_pages,
    "op5_warc_index_merge": warc.op5_warc_index_merge,
    "op6_budgeted_windows": chat.op6_budgeted_windows,
    "op7_bm25_packing": packing.op7_bm25_packing,
    "op8_elias_fano_files": token_files.op8_elias_fano_files,
    "op9_boosted_pii": pii.op9_boosted_pii,
    "op10_icws_neardup": neardup.op10_icws_neardup,
    "op11_nonnegative_pu": toxicity.op11_nonnegative_pu,
    "op12_pigeonhole_variants": variants.op12_pigeonhole_variants,
    "op13_bit_parallel_middle": middle.op13_bit_parallel_middle,
}
ORACLES = {
    "op1_temporal_url_lists": url_filter.ORACLE,
    "op2_risk_controlled_rules": quality.ORACLE,
    "op5_warc_index_merge": warc.ORACLE,
    "op6_budgeted_windows": chat.ORACLE,
    "op13_bit_parallel_middle": middle.ORACLE,
}
