"""The engine in SQL: functions and table functions of a session.

    register(spark)
    SELECT lex_roman(1998), lex_natural_key('12/A')
    SELECT t.id, c.* FROM t, LATERAL lex_analyze(t.text) c WHERE c.what = 'Citation'
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lexweave.kernels import nested
from lexweave.kernels.citations import analyze, interesting
from lexweave.kernels.numerals import MONTHS, ORDINALS, ROMAN
from lexweave.operators.sentences import _FIELDS, _rows

#: name and parameters, type, and the expression of every SQL function. They are inlined into plans like any other expression.
FUNCTIONS = {
    "lex_quote_change(s STRING)": ("INT", "regexp_count(s, '[„“]') - regexp_count(s, '”')"),
    "lex_natural_key(s STRING)": ("ARRAY<STRUCT<s: STRING, n: BIGINT>>", "transform(regexp_extract_all(s, '([0-9]+|[^0-9]+)', 1), x -> named_struct('s', if(x rlike '^[0-9]+$', '', x), 'n', if(x rlike '^[0-9]+$', cast(x as bigint), -1L)))"),
    "lex_roman(n INT)": ("STRING", "CASE WHEN n > 0 THEN aggregate(array(" + ", ".join(f"named_struct('v', {v}, 's', '{s}')" for v, s in ROMAN) + "), named_struct('rest', n, 'out', ''), (a, x) -> named_struct('rest', cast(a.rest % x.v as int), 'out', concat(a.out, repeat(x.s, cast(floor(a.rest / x.v) as int)))), a -> a.out) END"),
    "lex_ordinal(s STRING)": ("INT", "element_at(map(" + ", ".join(f"'{w}', {n}" for w, n in ORDINALS.items()) + "), lower(s))"),
    "lex_month(s STRING)": ("INT", "nullif(cast(array_position(array(" + ", ".join(f"'{m}'" for m in MONTHS) + "), s) as int), 0)"),
}


# Arrow table functions would be called by batches, but Spark does not let them stand in a lateral join, which is how these are used.
@udtf(returnType=", ".join(f"{c} {t}" for c, _, t in _FIELDS))
class Analyze:
    """Citations, abbreviations and records of a sentence."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None and interesting(text):
            for row in _rows(analyze(text)):
                yield tuple(row.get(c) for c, _, _ in _FIELDS)


@udtf(returnType="node_path string, parent_path string, kind string, identifier string, pre int, post int, depth int")
class Nodes:
    """Elements of a nested record."""

    def eval(self, children: str) -> Iterator[tuple]:
        found = nested.label(children)
        for n, (path, above, depth, _) in zip(found, nested.link(found), strict=True):
            yield path, above, n.kind, n.identifier, n.pre, n.post, depth


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; a second call replaces them."""
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    spark.udtf.register("lex_analyze", Analyze)
    spark.udtf.register("lex_nodes", Nodes)
