"""The queries of this subpackage, by name, and the SQL that checks them."""

from __future__ import annotations

from palimpsest.llm import chat_format, dedup_exact, embedding_dedup, language_id, mixing, ngram_join, packing, secrets, token_counts, toxicity

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_ngram_jaccard": ngram_join.op3_ngram_jaccard,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_exact_dedup": dedup_exact.op6_exact_dedup,
    "op7_packing": packing.op7_packing,
    "op8_language_id": language_id.op8_language_id,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op9_secret_scan_repositories": secrets.op9_secret_scan,  # its name before op9_secret_scan counted repositories too
    "op10_embedding_near_dedup": embedding_dedup.op10_embedding_near_dedup,
}

SQL = {
    "op1_chat_format": chat_format.OP1_SQL,
    "op6_exact_dedup": dedup_exact.OP6_SQL,
    "op9_secret_scan": secrets.OP9_SQL,
    "op9_secret_scan_repositories": secrets.OP9_SQL,
}
