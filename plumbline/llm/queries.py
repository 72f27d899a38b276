"""The queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op4_quality_attention": "quality",
    "op7_language_id": "language",
    "op1_warc_archive": "warc",
    "op5_audio_features": "audio",
    "op6_poisson_mix": "mixing",
    "op10_line_dedup": "line_dedup",
    "op8_ngram_jaccard": "jaccard",
    "op2_token_records": "token_records",
    "op3_token_counts": "token_counts",
    "op9_decontaminate": "decontaminate",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
