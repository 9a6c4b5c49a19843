"""All queries and checks."""

from tallymark.plans import (
    catalog_queries,
    document_queries,
    label_queries,
    metric_queries,
    scoring_queries,
)

_MODULES = (label_queries, scoring_queries, metric_queries, document_queries, catalog_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
CHECKS = {name: sql for module in _MODULES for name, sql in module.CHECKS.items()}
