"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from curalith.llm import op5_chat_format, op13_dual_tree
from curalith.llm.op1_multi_index_hashing import op1_multi_index_hashing
from curalith.llm.op2_toxicity import op2_toxicity
from curalith.llm.op3_suffix_dedup import op3_suffix_dedup
from curalith.llm.op4_best_fit_packing import op4_best_fit_packing
from curalith.llm.op6_paragraph_minhash import op6_paragraph_minhash
from curalith.llm.op7_ngram_jaccard_join import op7_ngram_jaccard_join
from curalith.llm.op8_multiset_hash import op8_multiset_hash
from curalith.llm.op9_token_files import op9_token_files
from curalith.llm.op10_byte_bpe import op10_byte_bpe
from curalith.llm.op11_token_alignment import op11_token_alignment
from curalith.llm.op12_simhash_variants import op12_simhash_variants

QUERIES = {
    "op1_multi_index_hashing": op1_multi_index_hashing,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_chat_format": op5_chat_format.op5_chat_format,
    "op6_paragraph_minhash": op6_paragraph_minhash,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_multiset_hash": op8_multiset_hash,
    "op9_token_files": op9_token_files,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_token_alignment": op11_token_alignment,
    "op12_simhash_variants": op12_simhash_variants,
    "op13_dual_tree": op13_dual_tree.op13_dual_tree,
}

ORACLE: dict[str, str] = {
    "op5_chat_format": op5_chat_format.ORACLE_SQL,
    "op13_dual_tree": op13_dual_tree.ORACLE_SQL,
}
