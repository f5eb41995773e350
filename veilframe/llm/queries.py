"""The queries of this subpackage and, where SQL can express them, their oracles."""

from . import decontaminate, licenses, mixing, neardup, packing, passages, quality, suffixes, tokens, urls

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_pack_tokens": packing.op2_pack_tokens,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_near_passages": passages.op6_near_passages,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_url_filter": urls.op9_url_filter,
    "op10_token_counts": tokens.op10_token_counts,
}

ORACLES = {
    "op5_near_duplicates": neardup.SQL,
    "op7_suffix_dedup": suffixes.SQL,
    "op8_decontaminate": decontaminate.SQL,
}
