"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from sediment.llm import bpe, fingerprints, jaccard, lines, mixing, pfor, pii, quality, sharding, substrings

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_pii": pii.op3_pii,
    "op4_vector_shards": sharding.op4_vector_shards,
    "op5_ngram_jaccard_join": jaccard.op5_ngram_jaccard_join,
    "op6_closed_syncmers": fingerprints.op6_closed_syncmers,
    "op7_pfor_tokens": pfor.op7_pfor_tokens,
    "op8_relative_lz": substrings.op8_relative_lz,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_fertility": quality.op10_fertility,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": lines.OP1_SQL,
    "op5_ngram_jaccard_join": jaccard.OP5_SQL,
    "op8_relative_lz": substrings.OP8_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
}
