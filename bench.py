"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

from amrspark.plans import catalog
from amrspark.session import build_session

HEADLINE = (
    "label_table", "label_votes", "label_conflicts", "drug_counts", "manifest", "eligible_ids",
    "mlst_groups", "holdout_group", "fold_balance", "leakage_check", "grouped_folds", "split_rows",
    "hit_pivot", "feature_vectors", "vocabulary", "matrix_rows", "engineered", "gate_calls",
    "catalog_fallback", "binary_metrics", "auroc", "average_precision", "metric_slices",
    "reliability", "conformal_fit", "conformal_eval", "alpha_grid", "evidence_topk", "verdicts",
    "report_rows", "narrative", "grounding_audit", "bm25_topk", "dense_topk", "rrf_topk",
    "fasta_qc", "hit_validation", "incremental_ingest", "capped_subset", "model_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(catalog.QUERIES)
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["evidence_counts"](spark, sf_dir).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).replace("sf", "")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
