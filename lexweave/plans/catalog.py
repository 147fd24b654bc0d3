"""All queries of the core, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.plans import act_queries, citation_queries, line_queries, nested_queries, scalar_queries

MODULES = (citation_queries, act_queries, line_queries, scalar_queries, nested_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query."""
    return citation_queries.enforcement_dates(spark, sf_dir)
