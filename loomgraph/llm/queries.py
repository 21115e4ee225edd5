"""The queries of this subpackage, by name."""

from __future__ import annotations

from loomgraph.llm import ann, fingerprint, licenses, packing, quality, sentencepiece_bpe, simhash, sstable, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_fingerprint": fingerprint.op1_fingerprint,
        "op2_sstable": sstable.op2_sstable,
        "op3_quality": quality.op3_quality,
        "op4_licenses": licenses.op4_licenses,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_sentencepiece": sentencepiece_bpe.op6_sentencepiece,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_ann": ann.op8_ann,
        "op9_packing": packing.op9_packing,
        "op10_simhash": simhash.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {}
