"""Time the headline queries; prints one JSON line.

Every query runs twice on the whole tables with a no-op sink: the first run
includes code generation and input caching, the second is what is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from postlab.plans import QUERIES

HEADLINE = [
    "t11a_clean_train", "t11b_clean_lexicon_full", "t12_tokenize", "t15_drop_noise_tokens",
    "l2_has_category_term", "l3_count_all_terms", "l3_count_phrases", "l3_count_terms_join",
    "l5_weighted_lexicon_vector", "l7_token_document_frequency", "l9_class_lexicon_disjoint",
    "f1_tfidf", "f1_top_terms_per_language", "f8_encode_sequence",
    "b1_sample_fraction", "b4_balance_to_minority", "b5_shuffle", "m8_assign_folds",
    "j1_join_labels", "u1_append_aux_corpus",
    "e4_classification_report", "e7_multitask_eval", "e12_select_best_epoch_f1",
    "m1_logistic_regression", "m3_linear_svm",
]
FITTED = {"m1_logistic_regression", "m3_linear_svm"}


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("postlab-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = sys.argv[1:] or HEADLINE
    spark = session()
    first, later = {}, {}
    for name in chosen:
        first[name] = round(timed(spark, name, sf_dir), 3)
        # Fits are dominated by their passes over the data, not by warm-up.
        later[name] = first[name] if name in FITTED else round(timed(spark, name, sf_dir), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(later.values()), 3), "unit": "sec",
        "queries": later, "first_run": first, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
