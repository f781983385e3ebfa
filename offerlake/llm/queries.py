"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

# Query -> module that holds it; a module's SQL for DuckDB, where there is any, is named beside it.
MODULES = {
    "op1_bpe_encoding": "bpe",
    "op2_quality_classifier": "quality",
    "op3_nearest_neighbours": "permutation_index",
    "op4_decontamination": "decontaminate",
    "op5_ngram_jaccard_join": "near_copies",
    "op6_pii": "pii",
    "op7_language_id": "language",
    "op9_suffix_array_dedup": "repeats",
    "op8_url_filters": "url_rules",
    "op10_license_scans": "licence_scan",
    "op11_merkle_manifest": "merkle",
    "op12_warc": "web_archive",
    "op13_lexical_search": "lexical",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"offerlake.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from offerlake.llm import lexical, licence_scan, merkle, url_rules, web_archive

    return {
        "op8_url_filters": url_rules.SQL,
        "op10_license_scans": licence_scan.oracle(),
        "op11_merkle_manifest": merkle.SQL,
        "op12_warc": web_archive.SQL,
        "op13_lexical_search": lexical.SQL,
    }
