"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quarryline.llm import q_html_text, q_language, q_mixing, q_ogg, q_pieces, q_prefix_trie, q_repeats, q_secret_scan, q_simhash, q_sketches, q_spelling, q_token_files, q_toxicity

MODULES = (q_mixing, q_simhash, q_sketches, q_token_files, q_html_text, q_pieces, q_language, q_toxicity, q_repeats, q_ogg, q_spelling, q_prefix_trie, q_secret_scan)
QUERIES: dict = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
