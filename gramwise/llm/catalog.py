"""The registered text queries and the SQL that checks them."""

from __future__ import annotations

from gramwise.llm import (
    decontaminate, exact_dedup, language, merkle, minhash, negatives, ngram_join, packing, pii, ppm, secrets, suffix_dedup, warc,
)

QUERIES = {
    "op1_ppm": ppm.op1_ppm,
    "op2_warc": warc.op2_warc,
    "op3_language": language.op3_language,
    "op4_pii": pii.op4_pii,
    "op5_packing": packing.op5_packing,
    "op6_secrets": secrets.op6_secrets,
    "op7_minhash": minhash.op7_minhash,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_ngram_jaccard": ngram_join.op10_ngram_jaccard,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_merkle": merkle.op12_merkle,
    "op13_negatives": negatives.op13_negatives,
}

ORACLES = {
    "op2_warc": warc.ORACLE,
    "op10_ngram_jaccard": ngram_join.ORACLE,
    "op11_exact_dedup": exact_dedup.ORACLE,
    "op12_merkle": merkle.ORACLE,
    "op13_negatives": negatives.ORACLE,
}
