"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from . import containment, conversations, dartminhash, merkle, mixing, negatives, ngrams, quality, secrets, suffix_array, suffix_automata, tokens, toxicity
from .common import Query


def queries() -> dict[str, Query]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_secrets": secrets.op2_secrets,
        "op3_suffix_array_dedup": suffix_array.op3_suffix_array_dedup,
        "op4_dartminhash": dartminhash.op4_dartminhash,
        "op5_containment": containment.op5_containment,
        "op6_merkle_fingerprints": merkle.op6_merkle_fingerprints,
        "op7_mixing": mixing.op7_mixing,
        "op8_token_counts": tokens.op8_token_counts,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_suffix_automata_dedup": suffix_automata.op10_suffix_automata_dedup,
        "op11_conversation_repair": conversations.op11_conversation_repair,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_lm_scores": ngrams.op13_lm_scores,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_suffix_array_dedup": suffix_array.OP3_SQL,
        "op4_dartminhash": dartminhash.OP4_SQL,
        "op5_containment": containment.OP5_SQL,
        "op6_merkle_fingerprints": merkle.OP6_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op10_suffix_automata_dedup": suffix_automata.OP10_SQL,
        "op11_conversation_repair": conversations.OP11_SQL,
        "op12_hard_negatives": negatives.OP12_SQL,
    }
