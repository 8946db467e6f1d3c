"""The operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from lexiloom.llm import bpe, chat, decontam, langid, ngram_join, pii, secrets, sentences, toxicity, vectors

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_pii": pii.op2_pii,
    "op3_ngram_jaccard": ngram_join.op3_ngram_jaccard,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_chat_format": chat.op7_chat_format,
    "op8_sentence_spans": sentences.op8_sentence_spans,
    "op9_bpe_coding": bpe.op9_bpe_coding,
    "op10_embedding_near_dups": vectors.op10_embedding_near_dups,
}

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard": ngram_join.OP3_SQL,
    "op4_secret_scan": secrets.OP4_SQL,
    "op6_decontamination": decontam.OP6_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op10_embedding_near_dups": vectors.OP10_SQL,
}
