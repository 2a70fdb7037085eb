"""The registered queries of this package and their SQL."""

from __future__ import annotations

from tessera.llm.ann import op2_nearest_vectors
from tessera.llm.bpe import op8_byte_bpe
from tessera.llm.fingerprint import OP3_SQL, op3_fingerprints
from tessera.llm.langid import op1_language_id
from tessera.llm.licenses import OP13_SQL, op13_license_scan
from tessera.llm.line_dedup import OP5_SQL, op5_line_dedup
from tessera.llm.mixing import OP6_SQL, op6_mix_sources
from tessera.llm.near_dedup import op7_near_duplicates
from tessera.llm.periodic import op11_periodic_runs
from tessera.llm.quality import op9_quality
from tessera.llm.toxicity import op4_toxicity
from tessera.llm.turn_trie import OP12_SQL, op12_turn_trie
from tessera.llm.url_filter import OP10_SQL, op10_url_filters

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_nearest_vectors": op2_nearest_vectors,
    "op3_fingerprints": op3_fingerprints,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality": op9_quality,
    "op10_url_filters": op10_url_filters,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_turn_trie": op12_turn_trie,
    "op13_license_scan": op13_license_scan,
}
ORACLE_SQL = {
    "op3_fingerprints": OP3_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_mix_sources": OP6_SQL,
    "op10_url_filters": OP10_SQL,
    "op12_turn_trie": OP12_SQL,
    "op13_license_scan": OP13_SQL,
}
