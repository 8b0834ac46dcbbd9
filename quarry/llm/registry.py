"""The queries of this subpackage and their SQL, where SQL can express them."""

from importlib import import_module

MODULES = ("token_files", "string_kernel", "bwt_dedup", "trie_bpe", "chat_rotation", "jaccard_join", "embedding_dedup", "string_tiling", "gam_quality", "class_lm")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"quarry.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
