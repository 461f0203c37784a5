"""The corpus operators' queries and their DuckDB equivalents."""

from __future__ import annotations

from skinnyla.llm import fingerprints, licenses, mixing, near_duplicates, neighbours, packing, personal_data, token_counts, toxicity, url_filters


def queries() -> dict:
    return {
        "op1_neighbours": neighbours.query,
        "op2_ngram_jaccard_join": near_duplicates.query,
        "op3_fingerprints": fingerprints.query,
        "op4_license_scans": licenses.query,
        "op5_packing": packing.query,
        "op6_url_filters": url_filters.query,
        "op7_personal_data": personal_data.query,
        "op8_mixing": mixing.query,
        "op9_toxicity": toxicity.query,
        "op10_token_counts": token_counts.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filters": url_filters.ORACLE}
