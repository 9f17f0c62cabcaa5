"""The ten operators as named queries over the driver tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from lattica.llm import chat, decontam, embed, jaccard, packing, pii, quality, sharding, toxicity, url_filter

QUERIES = {
    "op1_url_filters": url_filter.query,
    "op2_packing": packing.query,
    "op3_chat": chat.query,
    "op4_quality": quality.query,
    "op5_decontamination": decontam.query,
    "op6_ngram_jaccard": jaccard.query,
    "op7_sharding": sharding.query,
    "op8_toxicity": toxicity.query,
    "op9_embedding_dedup": embed.query,
    "op10_pii": pii.query,
}
ORACLE_SQL = {
    "op1_url_filters": url_filter.ORACLE_SQL,
    "op5_decontamination": decontam.ORACLE_SQL,
    "op6_ngram_jaccard": jaccard.ORACLE_SQL,
    "op7_sharding": sharding.ORACLE_SQL,
    "op9_embedding_dedup": embed.ORACLE_SQL,
}
