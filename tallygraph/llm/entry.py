"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clustering, context_tree, decontaminate, language_id, merkle, near_dup, neighbours, packing, secret_scan, substring_dedup, token_count, top_search, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_near_duplicates": near_dup.op1_near_duplicates,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_nearest": neighbours.op4_nearest,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_token_count": token_count.op6_token_count,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_language_id": language_id.op9_language_id,
        "op10_lm_scores": context_tree.op10_lm_scores,
        "op11_centroid_clusters": clustering.op11_centroid_clusters,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_top_products": top_search.op13_top_products,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": url_filter.oracle(),
        "op7_secret_scan": secret_scan.oracle(),
        "op11_centroid_clusters": clustering.oracle(),
        "op12_merkle_manifest": merkle.oracle(),
        "op13_top_products": top_search.oracle(),
    }
