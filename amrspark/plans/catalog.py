"""All registered queries and the SQL that checks them."""

from amrspark.plans import (
    audit_queries,
    decide_queries,
    feature_queries,
    group_queries,
    label_queries,
    metric_queries,
    model_queries,
    retrieval_queries,
    source_queries,
)

_MODULES = (
    audit_queries,
    label_queries,
    group_queries,
    feature_queries,
    metric_queries,
    model_queries,
    decide_queries,
    retrieval_queries,
    source_queries,
)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
