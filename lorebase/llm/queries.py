"""The corpus operators' registered queries and, where SQL can express them, their DuckDB equivalents."""

from . import language_id, lm_scoring, mixing, near_duplicates, packing, periodic_runs, personal_data, quality, sharding, token_counts, topk_search, url_filters, whitening

_ALL = {"op1_url_filters": url_filters, "op2_exact_topk_search": topk_search, "op3_ngram_jaccard_join": near_duplicates, "op4_language_id": language_id, "op5_quality_rules": quality, "op6_token_counts": token_counts, "op7_sharding": sharding, "op8_mixing": mixing, "op9_best_fit_packing": packing, "op10_lm_scoring": lm_scoring, "op11_pii": personal_data, "op12_embedding_whitening": whitening, "op13_periodic_runs": periodic_runs}
QUERIES = {name: module.query for name, module in _ALL.items()}
ORACLES = {name: module.ORACLE for name, module in _ALL.items() if getattr(module, "ORACLE", None)}
