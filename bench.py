"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from panelwise.plans.queries import QUERIES

HEADLINE = [
    "baseline_endpoint_rate", "harmonise_cohorts", "model_table", "attrition_report", "carry_from_baseline",
    "column_profile", "trajectories", "sample_impute", "stack_imputations", "minority_knn", "smote", "one_hot",
    "bootstrap_weights", "bootstrap_weights_poisson", "bootstrap_classification", "c_statistic",
    "calibration_slope", "roc_curve", "calibration_table", "validation_report", "lasso_coefficients",
    "linear_svm", "gbt_train", "mlp_train", "shap_values", "forest_impute",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("sum(o_totalprice)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
