"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, exact_dedup, fingerprint, jaccard, kneser_ney, langid, mixing, packing, repeats, toxicity


def queries() -> dict:
    return {
        "op1_pack_documents": packing.op1_pack_documents,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_lm_scoring": kneser_ney.op5_lm_scoring,
        "op6_suffix_array_dedup": repeats.op6_suffix_array_dedup,
        "op7_language_id": langid.op7_language_id,
        "op8_jaccard_join": jaccard.op8_jaccard_join,
        "op9_chat_format": chat.op9_chat_format,
        "op10_document_fingerprints": fingerprint.op10_document_fingerprints,
    }


def oracle_sql() -> dict:
    return {"op2_exact_dedup": exact_dedup.ORACLE, "op4_mix_sources": mixing.ORACLE, "op9_chat_format": chat.ORACLE}
