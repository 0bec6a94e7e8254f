"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import op1_language, op2_toxicity, op3_quality, op4_transducer, op5_chat, op6_hashing, op7_minhash, op8_embedding, op9_secrets, op10_packing

QUERIES = {
    "op1_language": op1_language.query,
    "op2_toxicity": op2_toxicity.query,
    "op3_quality": op3_quality.query,
    "op4_transducer": op4_transducer.query,
    "op5_chat": op5_chat.query,
    "op6_hashing": op6_hashing.query,
    "op7_minhash": op7_minhash.query,
    "op8_embedding": op8_embedding.query,
    "op9_secrets": op9_secrets.query,
    "op10_packing": op10_packing.query,
}

SQL: dict[str, str] = {
    "op5_chat": op5_chat.SQL,
    "op7_minhash": op7_minhash.SQL,
    "op8_embedding": op8_embedding.SQL,
}
