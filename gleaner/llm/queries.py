"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_bpe, embedding_dedup, exact_dedup, group_packing, language_id, lexical_search, line_dedup, packing, simhash, spelling, substring_dedup, suffix_dedup, warc

_MODULES = (line_dedup, exact_dedup, language_id, byte_bpe, packing, embedding_dedup, suffix_dedup, warc, simhash, substring_dedup, spelling, lexical_search, group_packing)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
