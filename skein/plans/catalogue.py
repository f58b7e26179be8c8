"""All catalogue queries and their SQL."""

from __future__ import annotations

from skein.plans import answers, base, ingest, policy, retrieval  # noqa: F401


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.ORACLES)


def entry(spark, sf_dir):
    """The flagship query: hybrid search with fusion, policy and evidence."""
    return base.QUERIES["hybrid_search"](spark, sf_dir)
