"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from cairn.llm import decontam, jaccard, licenses, lines, packing, quality, shards, substrings, topk, urls
from cairn.llm.common import table


def op1_line_dedup(spark, sf_dir):
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op2_decontamination(spark, sf_dir):
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op4_minimax_shards(spark, sf_dir):
    return shards.minimax_shards(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_url_filters(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op8_ngram_jaccard_join(spark, sf_dir):
    found = jaccard.similar_components(table(spark, sf_dir, "documents"), k=4, num=85)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op9_substring_dedup(spark, sf_dir):
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op10_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_decontamination,
        op3_exact_top_k,
        op4_minimax_shards,
        op5_quality_classifier,
        op6_best_fit_packing,
        op7_url_filters,
        op8_ngram_jaccard_join,
        op9_substring_dedup,
        op10_license_scan,
    )
}
ORACLES = {
    "op1_line_dedup": lines.dedup_sql(),
    "op3_exact_top_k": topk.top_k_sql(),
    "op7_url_filters": urls.judge_sql(),
    "op10_license_scan": licenses.scan_sql(),
}
