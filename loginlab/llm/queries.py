"""The named queries of this subpackage and their SQL."""

import corpus_pipeline
from loginlab.llm import byte_bpe, exact_dedup, languages, lexical_search, licenses, near_duplicates, nearest, packing, site_lines, token_counts, url_filters, vector_codes, warc

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_license_scans": licenses.op4_license_scans,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op10_site_lines": site_lines.op10_site_lines,
    "op8_nearest_neighbours": nearest.op8_nearest_neighbours,
    "op6_ngram_jaccard_join": near_duplicates.op6_ngram_jaccard_join,
    "op9_language_id": languages.op9_language_id,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_warc": warc.op12_warc,
    "op13_vector_codes": vector_codes.op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_url_filters": url_filters.ORACLE_SQL,
    "op4_license_scans": licenses.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_site_lines": site_lines.ORACLE_SQL,
    "op11_lexical_search": lexical_search.ORACLE_SQL,
    "op12_warc": warc.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
