"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import q_ann, q_bpe, q_chat, q_langid, q_linededup, q_merkle, q_mixing, q_ngramjoin, q_quality, q_repeats, q_simhash, q_trie, q_urlfilter

MODULES = (q_ann, q_bpe, q_chat, q_langid, q_linededup, q_merkle, q_mixing, q_ngramjoin, q_quality, q_repeats, q_simhash, q_trie, q_urlfilter)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
