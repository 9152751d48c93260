"""The registered queries of the package and the SQL of those that SQL can express."""

from __future__ import annotations

from quillvec.llm import (
    ann_pstable,
    bpe_words,
    decontam_pigeonhole,
    dedup_perfect_hash,
    jaccard_groups,
    langid_ftrl,
    quality_ordinal,
    resample_table,
    shard_interleave,
    tokens_bitplane,
    toxicity_crf,
    url_markov,
    whitening_blocks,
)

QUERIES = {
    "op1_quality_ordinal": quality_ordinal.query,
    "op2_toxicity_crf": toxicity_crf.query,
    "op3_bpe_words": bpe_words.query,
    "op4_langid_ftrl": langid_ftrl.query,
    "op5_decontam_pigeonhole": decontam_pigeonhole.query,
    "op6_shard_interleave": shard_interleave.query,
    "op7_url_markov": url_markov.query,
    "op8_tokens_bitplane": tokens_bitplane.query,
    "op9_ann_pstable": ann_pstable.query,
    "op10_jaccard_groups": jaccard_groups.query,
    "op11_whitening_blocks": whitening_blocks.query,
    "op12_dedup_perfect_hash": dedup_perfect_hash.query,
    "op13_resample_table": resample_table.query,
}

SQL: dict[str, str] = {
    "op12_dedup_perfect_hash": dedup_perfect_hash.SQL,
    "op13_resample_table": resample_table.SQL,
}
