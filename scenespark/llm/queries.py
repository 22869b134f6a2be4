"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from scenespark.llm import codes, decontam, licenses, lines, pii, quality, simhash, tokens, urls

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_pii": pii.op3_pii,
    "op4_url_filter": urls.op4_url_filter,
    "op5_top_k": codes.op5_top_k,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_packing": tokens.op7_packing,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_quality": quality.op9_quality,
}

ORACLE_SQL = {
    "op1_line_dedup": lines.OP1_SQL,
    "op2_license_scan": licenses.oracle_sql(),
    "op4_url_filter": urls.OP4_SQL,
    "op5_top_k": codes.OP5_SQL,
}
