"""Registered queries of this package and their DuckDB twins."""

from __future__ import annotations

from claimscope.llm.collocations import OP11_SQL, op11_collocations
from claimscope.llm.decontaminate import op8_decontamination
from claimscope.llm.fingerprints import OP6_SQL, op6_fingerprints
from claimscope.llm.html_extract import op1_html_text
from claimscope.llm.language_id import op5_language_id
from claimscope.llm.near_dedup import op4_minhash_near_dedup
from claimscope.llm.packing import op10_packing
from claimscope.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from claimscope.llm.sharding import OP12_SQL, op12_sharding
from claimscope.llm.substring_dedup import op9_substring_dedup
from claimscope.llm.token_counts import op3_token_counts
from claimscope.llm.url_lists import OP7_SQL, op7_url_lists
from claimscope.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_warc": op2_warc,
    "op3_token_counts": op3_token_counts,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_language_id": op5_language_id,
    "op6_fingerprints": op6_fingerprints,
    "op7_url_lists": op7_url_lists,
    "op8_decontamination": op8_decontamination,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_sharding": op12_sharding,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op6_fingerprints": OP6_SQL,
    "op7_url_lists": OP7_SQL,
    "op11_collocations": OP11_SQL,
    "op12_sharding": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
