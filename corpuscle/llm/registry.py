"""The operators' queries and SQL, by name."""

from __future__ import annotations

from . import bpe, decontaminate, embedding, langid, license, linededup, lm, oracle, simhash, substring, tokenfile, toxicity, trie, whitening


def queries() -> dict:
    return {
        "op1_embedding_near_dedup": embedding.op1,
        "op2_token_files": tokenfile.op2,
        "op3_lm_scores": lm.op3,
        "op4_license_scan": license.op4,
        "op5_bpe_codec": bpe.op5,
        "op6_simhash_near_dedup": simhash.op6,
        "op7_decontamination": decontaminate.op7,
        "op8_language_id": langid.op8,
        "op9_line_dedup": linededup.op9,
        "op10_toxicity": toxicity.op10,
        "op11_whitening": whitening.op11,
        "op12_prefix_trie": trie.op12,
        "op13_substring_dedup": substring.op13,
    }


def oracle_sql() -> dict:
    """By query; the others (tokenizers, XXH64, alignments, trained models) are held to brute force in the tests."""
    return {"op1_embedding_near_dedup": oracle.OP1, "op9_line_dedup": oracle.OP9, "op12_prefix_trie": oracle.OP12, "op13_substring_dedup": oracle.OP13}
