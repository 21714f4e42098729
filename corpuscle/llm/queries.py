"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from corpuscle.llm import alignment, bpe, decontamination, exact_dedup, languages, licenses, mixing, near_dedup, periodic_runs, quality, secrets, token_file, transport_stream

QUERIES = {
    "op1_secret_scan": secrets.op1,
    "op2_minhash_near_dedup": near_dedup.op2,
    "op3_language_profiles": languages.op3,
    "op4_exact_dedup": exact_dedup.op4,
    "op5_pivotal_mixing": mixing.op5,
    "op6_license_scan": licenses.op6,
    "op7_compression_quality": quality.op7,
    "op8_transport_stream": transport_stream.op8,
    "op9_addressable_token_file": token_file.op9,
    "op10_bpe_chunk_reuse": bpe.op10,
    "op11_token_alignment": alignment.op11,
    "op12_suffix_automaton": decontamination.op12,
    "op13_periodic_runs": periodic_runs.op13,
}
ORACLE_SQL = {
    "op2_minhash_near_dedup": near_dedup.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op6_license_scan": licenses.ORACLE,
    "op12_suffix_automaton": decontamination.ORACLE,
}
