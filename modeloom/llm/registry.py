"""Queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from modeloom.llm import sql
from modeloom.llm.ann import op1_nearest
from modeloom.llm.balltree import op13_exact_topk
from modeloom.llm.bpe import op5_tree_bpe
from modeloom.llm.chat import op10_chat
from modeloom.llm.language import op7_language
from modeloom.llm.media import op6_media
from modeloom.llm.merkle import op11_merkle
from modeloom.llm.minhash import op2_minhash
from modeloom.llm.packing import op8_packing
from modeloom.llm.substrings import op9_substrings
from modeloom.llm.token_files import op3_token_files
from modeloom.llm.trie import op12_trie
from modeloom.llm.warc import op4_warc

QUERIES = {f.__name__: f for f in (op1_nearest, op2_minhash, op3_token_files, op4_warc, op5_tree_bpe, op6_media, op7_language, op8_packing, op9_substrings, op10_chat, op11_merkle, op12_trie, op13_exact_topk)}
ORACLE_SQL: dict[str, str] = {"op4_warc": sql.WARC, "op10_chat": sql.CHAT, "op11_merkle": sql.MERKLE, "op12_trie": sql.TRIE, "op13_exact_topk": sql.VECTORS}
