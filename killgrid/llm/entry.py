"""Queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from . import chat_format, divergence, exact_dedup, fingerprint, html_extract, language_id, license_scan, mixing, near_dedup, packing, periodic_runs, quality, suffix_dedup


def queries() -> dict:
    return {
        "op1_html_extract": html_extract.op1_html_extract,
        "op2_quality": quality.op2_quality,
        "op3_mix": mixing.op3_mix,
        "op4_pack": packing.op4_pack,
        "op5_chat_format": chat_format.op5_chat_format,
        "op6_language_id": language_id.op6_language_id,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_fingerprint": fingerprint.op9_fingerprint,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_license_scan": license_scan.op11_license_scan,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": chat_format.OP5_SQL, "op7_near_dedup": near_dedup.OP7_SQL, "op8_suffix_dedup": suffix_dedup.OP8_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL, "op11_license_scan": license_scan.OP11_SQL, "op13_divergence": divergence.OP13_SQL}
