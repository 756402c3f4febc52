"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from embedscope.llm.alignment import op12_token_alignment
from embedscope.llm.blocknames import OP3_SQL, op3_exact_dedup
from embedscope.llm.linktrust import OP6_SQL, op6_url_filter
from embedscope.llm.minhash import OP2_SQL, op2_near_dedup
from embedscope.llm.mixing import op10_mixing
from embedscope.llm.packing import op5_packing
from embedscope.llm.prefixhash import op11_prefix_fingerprints
from embedscope.llm.quality import op9_quality
from embedscope.llm.quotes import op8_quotation_links
from embedscope.llm.rotcodes import OP4_SQL, op4_embedding_dedup
from embedscope.llm.tokenfiles import op7_token_files
from embedscope.llm.toxicity import op1_toxicity
from embedscope.llm.variants import op13_spelling_variants

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_token_files": op7_token_files,
    "op8_quotation_links": op8_quotation_links,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_prefix_fingerprints": op11_prefix_fingerprints,
    "op12_token_alignment": op12_token_alignment,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {
    "op2_near_dedup": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op4_embedding_dedup": OP4_SQL,
    "op6_url_filter": OP6_SQL,
}
