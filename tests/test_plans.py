"""Plans keep to equi-joins, prune columns and push filters to the scan."""

import contextlib
import io
import re

import pytest

from amrspark.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
CHECKED = (
    "label_votes", "label_conflicts", "drug_counts", "eligible_ids", "mlst_groups",
    "holdout_group", "hit_pivot", "gate_calls", "catalog_fallback", "auroc", "metric_slices",
    "conformal_eval", "verdicts", "report_rows", "grounding_audit", "rrf_topk", "fasta_qc",
    "compatibility",
)


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_join(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scan_is_pruned_and_filtered(spark):
    plan = plan_of(catalog.QUERIES["holdout_group"](spark, SF_DIR))
    assert re.search(r"PushedFilters: \[.*o_orderstatus", plan)
    assert "o_totalprice" not in plan
    plan = plan_of(catalog.QUERIES["evidence_counts"](spark, SF_DIR))
    assert re.search(r"ReadSchema: struct<l_tax:double>", plan)


# The most shuffles, and scans of files, that a query may plan after its eager cuts.
LIMITS = {
    "label_table": (8, 1), "label_votes": (2, 1), "fasta_qc": (2, 1), "fasta_contigs": (0, 1),
    "hit_pivot": (1, 1), "vocabulary": (0, 0), "bm25_topk": (0, 0), "dense_topk": (0, 0),
    "rrf_topk": (0, 0), "grounding_audit": (24, 6), "report_documents": (22, 5), "verdicts": (20, 4),
    "report_rows": (21, 5), "split_rows": (33, 3), "manifest": (17, 17),
}


@pytest.mark.parametrize("name", sorted(LIMITS))
def test_shuffles_and_scans(spark, name):
    plan = catalog.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    shuffles = len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange ", plan))
    assert (shuffles, plan.count("FileScan")) <= LIMITS[name] and plan.count("FileScan") <= LIMITS[name][1]


def test_label_table_deals_its_rows_once(spark):
    plan = catalog.QUERIES["label_table"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange ", plan)) == 1
