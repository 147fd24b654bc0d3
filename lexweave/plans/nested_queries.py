"""Queries of the nested-records operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.nested import flatten_nested, link_tables, node_table
from lexweave.session import read


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per element; record ids are unique, so the rows are distinct without a shuffle."""
    nodes = flatten_nested(read(spark, sf_dir, "ambigous_points"))
    return nodes.select("record_id", "node_path", "parent_path", "kind", "identifier")


def p2_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element with its labels and contents."""
    return flatten_nested(read(spark, sf_dir, "ambigous_points"))


def p2_point_subpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alphabetic points with the alphabetic subpoints below them, two node tables joined by containment."""
    nodes = flatten_nested(read(spark, sf_dir, "ambigous_points"))
    return link_tables(node_table(nodes, "AlphabeticPoint"), node_table(nodes, "AlphabeticSubpoint"))


def p2_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements and greatest depth by kind."""
    nodes = flatten_nested(read(spark, sf_dir, "ambigous_points"))
    return nodes.groupBy("kind").agg(F.count("*").alias("n"), F.max("depth").cast("bigint").alias("deepest"))


QUERIES = {f.__name__: f for f in (p2_found, p2_nodes, p2_point_subpoints, p2_kind_counts)}
#: The objects of a level, which may be an array, one object, or a string of either.
_PLAIN = lambda level: f"CASE WHEN json_type({level}) = 'VARCHAR' THEN TRY_CAST({level} ->> '$' AS JSON) ELSE {level} END"
_OBJECTS = "list_filter(CASE json_type(level) WHEN 'ARRAY' THEN level::JSON[] WHEN 'OBJECT' THEN [level] ELSE []::JSON[] END, lambda o: json_type(o) = 'OBJECT')"
_STEP = f"SELECT record_id, path || '.' || i AS node_path, path AS parent_path, items[i] AS obj FROM (SELECT record_id, path, {_OBJECTS} AS items FROM {{levels}}), unnest(range(1, len(items) + 1)) AS u(i)"
_WALK = f"""WITH RECURSIVE r AS (SELECT record_id, CASE WHEN json_valid(children) THEN children::JSON END AS c FROM ambigous_points), w(record_id, node_path, parent_path, obj) AS (
    {_STEP.format(levels=f"(SELECT record_id, 'r' AS path, {_PLAIN('c')} AS level FROM r)")}
    UNION ALL {_STEP.format(levels=f"(SELECT record_id, path, {_PLAIN('c')} AS level FROM (SELECT record_id, node_path AS path, json_extract(obj, '$.children') AS c FROM w))")}),
  n AS (SELECT record_id, node_path, parent_path, coalesce(obj ->> '$.__type__', 'Paragraph') AS kind, coalesce(obj ->> '$.identifier', '') AS identifier FROM w)"""
SQL = {
    "p2_found": f"{_WALK} SELECT * FROM n",
    "p2_kind_counts": f"{_WALK} SELECT kind, count(*) AS n, max(len(string_split(node_path, '.')) - 1)::BIGINT AS deepest FROM n GROUP BY kind",
    "p2_point_subpoints": f"""{_WALK} SELECT c.record_id, c.parent_path, p.kind AS parent_kind, p.identifier AS parent_identifier, c.node_path, c.kind, c.identifier
      FROM n c JOIN n p ON p.record_id = c.record_id AND p.node_path = c.parent_path WHERE p.kind = 'AlphabeticPoint' AND c.kind = 'AlphabeticSubpoint'""",
}
