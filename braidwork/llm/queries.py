"""The queries of this package and their SQL."""

from __future__ import annotations

from . import centroids, decontaminate, language, mixing, neighbours, quality, resample, scoring, secrets, simhash, substrings, urls, warc

QUERIES = {
    "op1_lm_scoring": scoring.op1_lm_scoring,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_url_filter": urls.op5_url_filter,
    "op6_language_id": language.op6_language_id,
    "op7_nearest_neighbours": neighbours.op7_nearest_neighbours,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op11_importance_resampling": resample.op11_importance_resampling,
    "op12_centroid_clustering": centroids.op12_centroid_clustering,
    "op13_warc": warc.op13_warc,
}
SQL = {
    "op1_lm_scoring": scoring.OP1_SQL,
    "op4_secret_scan": secrets.OP4_SQL,
    "op5_url_filter": urls.OP5_SQL,
    "op8_benchmark_decontamination": decontaminate.OP8_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op10_substring_dedup": substrings.OP10_SQL,
    "op11_importance_resampling": resample.OP11_SQL,
    "op12_centroid_clustering": centroids.OP12_SQL,
    "op13_warc": warc.OP13_SQL,
}
