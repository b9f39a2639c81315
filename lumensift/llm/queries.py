"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, clusters, decontaminate, html, jaccard, langid, licenses, lm, packing, preferences, quality, substring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": html.op1_html_extraction,
    "op2_preference_formatting": preferences.op2_preference_formatting,
    "op3_substring_dedup": substring.op3_substring_dedup,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_language_id": langid.op8_language_id,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_lm_scoring": lm.op10_lm_scoring,
    "op11_byte_bpe": bpe.op11_byte_bpe,
    "op12_centroid_clustering": clusters.op12_centroid_clustering,
    "op13_filter_audit": audit.op13_filter_audit,
}

SQL: dict[str, str] = {
    "op2_preference_formatting": preferences.OP2_SQL,
    "op3_substring_dedup": substring.OP3_SQL,
    "op4_license_scan": licenses.OP4_SQL,
    "op5_jaccard_join": jaccard.OP5_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op12_centroid_clustering": clusters.OP12_SQL,
    "op13_filter_audit": audit.OP13_SQL,
}
