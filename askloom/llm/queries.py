"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import chat_format, decontamination, filter_audit, flac_media, hard_negatives, language_id, license_scan, mixing, quality, secret_scan, simhash, substring_dedup, token_output

QUERIES = {
    f.__name__: f
    for f in (
        substring_dedup.op1_substring_dedup,
        simhash.op2_simhash_components,
        language_id.op3_language_id,
        mixing.op4_mix_sources,
        token_output.op5_token_output,
        decontamination.op6_benchmark_decontamination,
        chat_format.op7_chat_format,
        flac_media.op8_flac_media,
        quality.op9_quality_classifier,
        license_scan.op10_license_scan,
        secret_scan.op11_secret_scan,
        filter_audit.op12_filter_audit,
        hard_negatives.op13_hard_negatives,
    )
}

#: SQL where it can express the operator: not for XXH64, trained models, tokenizers or FLAC.
ORACLES = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
    "op6_benchmark_decontamination": decontamination.OP6_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op10_license_scan": license_scan.OP10_SQL,
    "op11_secret_scan": secret_scan.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
