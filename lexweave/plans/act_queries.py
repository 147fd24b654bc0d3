"""Queries of acts as tables of elements: structure, amendments, context, references to elements, renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.operators import elements as E
from lexweave.operators import refs
from lexweave.operators import sentences as S
from lexweave.operators.semantics import analyze_elements
from lexweave.plans.nested_queries import _WALK
from lexweave.plans.register import register
from lexweave.session import cut_lineage, read
from lexweave.sinks import render
from lexweave.sources.lines import text_lines

MARK = "§"


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles of their customer's act, lines as paragraphs: o_custkey, article, o_orderkey, paragraph, p (a part)."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    numbered = o.withColumn("article", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    para = li.withColumn("paragraph", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    return numbered.join(para, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "article", "o_orderkey", "paragraph", "p")


def _acts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """act_id, text: those acts written out. Every third part's paragraph has points, every fifth's a quoted block."""
    pad = "       "
    first = F.concat(F.col("article"), F.lit(". §"), F.when(F.col("article") < 10, F.lit("   ")).when(F.col("article") < 100, F.lit("  ")).otherwise(F.lit(" ")))
    head = F.concat(F.when(F.col("paragraph") == 1, first).otherwise(F.lit(pad)), F.lit("("), F.col("paragraph"), F.lit(") "))
    points = F.concat(F.lit(f"Az alábbiak:\n{pad}a) "), F.col("p"), F.lit(f" alma;\n{pad}b) "), F.col("p"), F.lit(" körte-\n           fa."))
    quoted = F.concat(F.lit("A Vgt. 3. § (2) bekezdése helyébe a következő rendelkezés lép:\n" + pad + "„(2) Új "), F.col("p"), F.lit(" szöveg.”"))
    body = F.when(F.col("p") % 3 == 0, points).when(F.col("p") % 5 == 0, quoted).otherwise(F.concat(F.lit("Sima "), F.col("p"), F.lit(" szöveg.")))
    a = _articles(spark, sf_dir).withColumn("t", F.concat(head, body))
    by_article = a.groupBy("o_custkey", "article").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "t"))), lambda x: x["t"]), "\n").alias("t"))
    return by_article.groupBy(F.col("o_custkey").cast("string").alias("act_id")).agg(F.concat(F.lit("Bevezető szöveg\n\nELSŐ KÖNYV\nA KÖNYV CÍME\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article", "t"))), lambda x: x["t"]), "\n")).alias("text"))


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.parse_acts(text_lines(_acts_text(spark, sf_dir), "act_id", "text").withColumnRenamed("doc_id", "act_id"))


def act_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All elements of the acts, parsed from their lines."""
    return _elements(spark, sf_dir).select("act_id", "element_id", "parent_id", "kind", "identifier", "title", "text", "intro")


def act_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements that the quoted blocks of amending paragraphs hold."""
    opened = E.open_amendments(cut_lineage(_elements(spark, sf_dir)))
    return opened.select("act_id", "element_id", "parent_id", "kind", "identifier", "text", "in_amendment", "error")


def act_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of the parsed acts' own sentences, with positions in the element's text."""
    return _citations(cut_lineage(_elements(spark, sf_dir)))


def _citations(elements: DataFrame) -> DataFrame:
    e = E.with_context(elements.where("NOT in_amendment AND (text IS NOT NULL OR intro IS NOT NULL)"))
    found = S.analyze_sentences(e.withColumn("skip", F.length("prefix")).withColumn("most", F.length("sentence") - F.length("postfix")), ["act_id", "element_id", "skip", "most"], "sentence")
    c = S.citations(found, ["act_id", "element_id", "skip", "most"]).where("end_pos > skip AND end_pos <= most")
    return c.select("act_id", "element_id", F.greatest(F.col("start_pos") - F.col("skip"), F.lit(0)).cast("bigint").alias("start_pos"), (F.col("end_pos") - F.col("skip")).cast("bigint").alias("end_pos"), "act", "article_first", "paragraph_first")


def txt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.txt(cut_lineage(_elements(spark, sf_dir)))


def html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut_lineage(_elements(spark, sf_dir))
    links = _citations(e).withColumn("href", F.concat("act", F.lit(".html#"), F.coalesce("article_first", F.lit("")), F.lit("_"), F.coalesce("paragraph_first", F.lit("")), F.lit("__")))
    return render.html(e, links)


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The acts as nested JSON, and from it again as rows by the nested-records operator; acts longer than a part come part by part."""
    from lexweave.operators.nested import flatten_nested

    j = render.nested_json(_elements(spark, sf_dir)).select(F.col("act_id").cast("bigint").alias("record_id"), F.col("json").alias("children"))
    return flatten_nested(j).select(F.col("record_id").alias("o_custkey"), "kind", "identifier", "text")


def _deduped(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's elements without redeliveries; equal keys have equal contents, so one aggregation does it."""
    e = read(spark, sf_dir, table)
    return e.groupBy("act_id", "element_id").agg(*(F.min(c).alias(c) for c in ("parent_id", "kind", "identifier", "text", "intro", "wrap_up", "ord")))


def sentence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element's sentence between the intros and wrap-ups of what it stands in."""
    e = E.with_context(_deduped(spark, sf_dir, "btk_mod_1")).where("sentence IS NOT NULL")
    return e.select("act_id", "element_id", F.length("prefix").cast("bigint").alias("prefix_chars"), F.md5("sentence").alias("sentence_md5"))


def id_range_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and paragraphs from the second to the third of their siblings, by natural order."""
    e = _deduped(spark, sf_dir, "subpoints").where("kind IN ('Paragraph', 'NumericPoint') AND identifier IS NOT NULL")
    ranges = e.select("act_id", "parent_id").distinct().select(F.concat_ws("|", "act_id", "parent_id").alias("range_id"), "act_id", "parent_id", F.lit("2").alias("first"), F.lit("3").alias("last"))
    return E.cut_by_identifier(e, ranges).select("range_id", "element_id", "identifier")


def element_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.invariants(_deduped(spark, sf_dir, "dashes"))


def ref_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the range of an act's articles 1 to 3, and for its article 2: how many of the act's elements each holds."""
    e = _deduped(spark, sf_dir, "btk_mod_1").where("kind NOT IN ('Book', 'Part', 'Title', 'Chapter', 'Subtitle')")
    inner = e.select("act_id", "element_id", refs.from_id_string(F.regexp_replace("element_id", "_0_", "__"), F.col("act_id")).alias("inner_ref"))
    outer = e.select("act_id").distinct().select("act_id", F.explode(F.array(F.struct(F.lit("1-3").alias("name"), F.lit("1").alias("a"), F.lit("3").alias("b")), F.struct(F.lit("2").alias("name"), F.lit("2").alias("a"), F.lit("2").alias("b")))).alias("o"))
    o = outer.select("act_id", "o.name", refs.ref(F.col("act_id"), article=refs.level(F.col("o.a"), F.col("o.b"))).alias("outer_ref"))
    held = inner.join(o, "act_id").where(refs.contains(F.col("outer_ref"), F.col("inner_ref")))
    return held.groupBy("act_id", "name").agg(F.count("*").alias("n"))


CITED = r"([0-9]+)\. § \(([0-9]+)\) bekezdés"


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of their own act that the points of subpoints cite."""
    e = read(spark, sf_dir, "subpoints").where(F.col("text").rlike(CITED))
    hit = F.explode(F.regexp_extract_all("text", F.lit(CITED), F.lit(0)))
    return e.select("row_id", "act_id", hit.alias("cited")).select("row_id", "act_id", F.concat(F.regexp_extract("cited", CITED, 1), F.lit("_"), F.regexp_extract("cited", CITED, 2), F.lit("__")).alias("target"))


def links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _deduped(spark, sf_dir, "subpoints").select("act_id", F.col("element_id").alias("target"))
    return _cited(spark, sf_dir).join(ids, ["act_id", "target"]).select("row_id", "act_id", "target")


def links_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _deduped(spark, sf_dir, "subpoints").select("act_id", F.col("element_id").alias("target"))
    return _cited(spark, sf_dir).join(ids, ["act_id", "target"], "left_anti").select("row_id", "act_id", "target")


def parsed_acts_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts without any element in a table yet: what an incremental run has to parse."""
    done = read(spark, sf_dir, "dashes").select("act_id").distinct()
    return read(spark, sf_dir, "raw_acts").join(done, "act_id", "left_anti").select("act_id", "subject")


def ref_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs 2 to 3 of article 1, and article 2, of every act: the elements that these references name."""
    e = _deduped(spark, sf_dir, "btk_mod_1")
    acts = e.select("act_id").distinct()
    two = acts.select(F.explode(F.array(F.struct(F.concat("act_id", F.lit(" 1 (2)-(3)")).alias("ref_id"), refs.ref(F.col("act_id"), article=refs.level(F.lit("1")), paragraph=refs.level(F.lit("2"), F.lit("3"))).alias("reference")), F.struct(F.concat("act_id", F.lit(" 2")).alias("ref_id"), refs.ref(F.col("act_id"), article=refs.level(F.lit("2"))).alias("reference")))).alias("x")).select("x.*")
    return E.at_reference(e, two)


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's functions and table functions in SQL, over all orders and nested records."""
    register(spark)
    read(spark, sf_dir, "orders").createOrReplaceTempView("lex_orders")
    read(spark, sf_dir, "ambigous_points").createOrReplaceTempView("lex_records")
    return spark.sql("""SELECT kind, count(*) AS n FROM lex_records r, LATERAL lex_nodes(r.children) x GROUP BY kind
      UNION ALL SELECT concat('order ', lex_roman(cast(o_orderkey % 3999 + 1 as int))), count(*) FROM lex_orders GROUP BY 1""")


def semantic_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as paragraphs of their customer's act: even ones define a short name, odd ones cite by it; the citations, resolved."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("V"), F.substring(F.lit("abc"), (F.pmod(F.floor(F.col("o_orderkey") / 2), F.lit(3)) + 1).cast("int"), F.lit(1)), F.lit("t.")).alias("short"), F.concat(F.year("o_orderdate"), F.lit(". évi X. törvény")).alias("named"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("A vízről szóló "), F.col("named"), F.lit(" (a továbbiakban: "), F.col("short"), F.lit(") irányadó"))).otherwise(F.concat(F.lit("a "), F.col("short"), F.lit(" 3. §-a szerint, és")))
    null = F.lit(None).cast("string")
    e = o.select(F.col("o_custkey").cast("string").alias("act_id"), F.col("o_orderkey").cast("string").alias("element_id"), null.alias("parent_id"), F.array(F.col("o_orderkey").cast("int")).alias("path"), text.alias("text"), null.alias("intro"), null.alias("wrap_up"), F.lit(False).alias("in_amendment"))
    c = analyze_elements(e).citations
    return c.select(F.col("element_id").alias("o_orderkey"), F.col("start_pos").cast("bigint").alias("start_pos"), F.col("end_pos").cast("bigint").alias("end_pos"), "act", "article_first")


QUERIES = {f.__name__: f for f in (act_structure, act_amendments, act_citations, txt_render, html_render, json_round_trip, sentence_context, id_range_cut, element_invariants, ref_containment, links_resolved, links_broken, parsed_acts_missing, semantic_pass, ref_lookup, sql_functions)}

_ARTICLES = """a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS article FROM orders),
  li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS paragraph FROM li),
  x AS (SELECT o_custkey::VARCHAR AS act_id, article, paragraph, p FROM a JOIN n ON o_orderkey = l_orderkey), r AS (SELECT act_id, article, row_number() OVER (PARTITION BY act_id ORDER BY article) AS k FROM (SELECT DISTINCT act_id, article FROM x))"""
_STRUCTURE = f"""WITH {_ARTICLES},
  u AS (
    SELECT act_id, 'preamble' AS element_id, NULL AS parent_id, 'Preamble' AS kind, NULL AS identifier, NULL AS title, 'Bevezető szöveg' AS text, NULL AS intro FROM (SELECT DISTINCT act_id FROM x)
    UNION ALL SELECT act_id, 'book-1', NULL, 'Book', '1', 'A KÖNYV CÍME', NULL, NULL FROM (SELECT DISTINCT act_id FROM x)
    UNION ALL SELECT DISTINCT act_id, article || '___', NULL, 'Article', article::VARCHAR, NULL, NULL, NULL FROM x
    UNION ALL SELECT act_id, article || '_' || paragraph || '__', article || '___', 'Paragraph', paragraph::VARCHAR, NULL, CASE WHEN p % 3 <> 0 AND p % 5 <> 0 THEN 'Sima ' || p || ' szöveg.' END, CASE WHEN p % 3 = 0 THEN 'Az alábbiak:' WHEN p % 5 = 0 THEN 'A Vgt. 3. § (2) bekezdése helyébe a következő rendelkezés lép:' END FROM x
    UNION ALL SELECT act_id, article || '_' || paragraph || '_a_', article || '_' || paragraph || '__', 'AlphabeticPoint', 'a', NULL, p || ' alma;', NULL FROM x WHERE p % 3 = 0
    UNION ALL SELECT act_id, article || '_' || paragraph || '_b_', article || '_' || paragraph || '__', 'AlphabeticPoint', 'b', NULL, p || ' körte-fa.', NULL FROM x WHERE p % 3 = 0
    UNION ALL SELECT act_id, article || '_' || paragraph || '__.quotedblock-1', article || '_' || paragraph || '__', 'QuotedBlock', NULL, NULL, NULL, NULL FROM x WHERE p % 3 <> 0 AND p % 5 = 0)"""
_E = lambda t: f"e AS (SELECT act_id, element_id, min(parent_id) AS parent_id, min(kind) AS kind, min(identifier) AS identifier, min(text) AS text, min(intro) AS intro, min(wrap_up) AS wrap_up FROM {t} GROUP BY 1, 2)"
_END = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, ' és$', ''), ' valamint$', ''), ' illetve$', ''), ' vagy$', ''), ';$', ''), ',$', '')"
_UP = lambda k: f"LEFT JOIN e p{k} ON p{k}.act_id = e.act_id AND p{k}.element_id = {'e' if k == 1 else f'p{k - 1}'}.parent_id"
_CITED_SQL = r"""c AS (SELECT row_id, act_id, unnest(regexp_extract_all(text, '[0-9]+\. § \([0-9]+\) bekezdés')) AS h FROM subpoints), t AS (SELECT row_id, act_id, regexp_extract(h, '^([0-9]+)', 1) || '_' || regexp_extract(h, '\(([0-9]+)\)', 1) || '__' AS target FROM c)"""
_ROMAN_4K = "(repeat('M', {n} // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][{n} // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][{n} // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][{n} % 10 + 1])"
SQL = {
    "act_structure": f"{_STRUCTURE} SELECT * FROM u",
    "act_amendments": f"""WITH {_ARTICLES}, q AS (SELECT act_id, article || '_' || paragraph || '__' AS pid, p FROM x WHERE p % 3 <> 0 AND p % 5 = 0)
      SELECT act_id, pid || '.amendment' AS element_id, pid AS parent_id, 'BlockAmendmentContainer' AS kind, NULL AS identifier, NULL AS text, true AS in_amendment, NULL AS error FROM q
      UNION ALL SELECT act_id, pid || '.amendment/_2__', pid || '.amendment', 'Paragraph', '2', 'Új ' || p || ' szöveg.', true, NULL FROM q""",
    "act_citations": f"""WITH {_ARTICLES}, q AS (SELECT act_id, article || '_' || paragraph || '__' AS element_id FROM x WHERE p % 3 <> 0 AND p % 5 = 0)
      SELECT act_id, element_id, 2::BIGINT AS start_pos, 6::BIGINT AS end_pos, 'Vgt.' AS act, NULL AS article_first, NULL AS paragraph_first FROM q UNION ALL SELECT act_id, element_id, 7, 25, 'Vgt.', '3', '2' FROM q""",
    "json_round_trip": f"{_STRUCTURE} SELECT act_id::BIGINT AS o_custkey, kind, coalesce(identifier, '') AS identifier, text FROM u",
    "sentence_context": f"""WITH {_E('btk_mod_1')}, s AS (SELECT e.act_id, e.element_id, coalesce(p4.intro || ' ', '') || coalesce(p3.intro || ' ', '') || coalesce(p2.intro || ' ', '') || coalesce(p1.intro || ' ', '') AS prefix,
        CASE WHEN e.text IS NULL THEN '' ELSE coalesce(' ' || p1.wrap_up, '') || coalesce(' ' || p2.wrap_up, '') || coalesce(' ' || p3.wrap_up, '') || coalesce(' ' || p4.wrap_up, '') END AS postfix, coalesce(e.text, e.intro) AS m FROM e {' '.join(_UP(k) for k in range(1, 5))}),
      f AS (SELECT *, {_END} AS x FROM s WHERE m IS NOT NULL)
      SELECT act_id, element_id, length(prefix)::BIGINT AS prefix_chars, md5(prefix || CASE WHEN postfix = '' AND NOT regexp_matches(x, '[.:!?]$') THEN x || '.' ELSE x END || postfix) AS sentence_md5 FROM f""",
    "id_range_cut": f"WITH {_E('subpoints')} SELECT CASE WHEN parent_id IS NULL THEN act_id ELSE act_id || '|' || parent_id END AS range_id, element_id, identifier FROM e WHERE kind IN ('Paragraph', 'NumericPoint') AND regexp_matches(identifier, '^(2([^0-9].*)?|3)$')",
    "element_invariants": f"""WITH {_E('dashes')}, k AS (SELECT act_id, parent_id, count(*) AS n, count(*) FILTER (kind = 'Paragraph' AND identifier IS NULL) AS u FROM e GROUP BY 1, 2), j AS (SELECT e.*, k.n, k.u FROM e LEFT JOIN k ON k.act_id = e.act_id AND k.parent_id = e.element_id)
      SELECT act_id, element_id, 'text beside intro or wrap-up' AS violation FROM j WHERE text IS NOT NULL AND (intro IS NOT NULL OR wrap_up IS NOT NULL) UNION ALL SELECT act_id, element_id, 'text beside children' FROM j WHERE text IS NOT NULL AND n > 0
      UNION ALL SELECT act_id, element_id, 'unnumbered paragraph among several' FROM j WHERE kind = 'Article' AND n > 1 AND u > 0""",
    "ref_containment": f"""WITH {_E('btk_mod_1')}, i AS (SELECT act_id, split_part(element_id, '_', 1) AS a FROM e WHERE kind NOT IN ('Book', 'Part', 'Title', 'Chapter', 'Subtitle'))
      SELECT act_id, '1-3' AS name, count(*)::BIGINT AS n FROM i WHERE regexp_matches(a, '^([12]([^0-9].*)?|3)$') GROUP BY 1 UNION ALL SELECT act_id, '2', count(*) FROM i WHERE a = '2' GROUP BY 1""",
    "links_resolved": f"WITH {_CITED_SQL}, i AS (SELECT DISTINCT act_id, element_id FROM subpoints) SELECT row_id, t.act_id, target FROM t JOIN i ON i.act_id = t.act_id AND i.element_id = target",
    "links_broken": f"WITH {_CITED_SQL}, i AS (SELECT DISTINCT act_id, element_id FROM subpoints) SELECT row_id, t.act_id, target FROM t LEFT JOIN i ON i.act_id = t.act_id AND i.element_id = target WHERE i.act_id IS NULL",
    "parsed_acts_missing": "SELECT act_id, subject FROM raw_acts WHERE act_id NOT IN (SELECT act_id FROM dashes)",
    "semantic_pass": """WITH o AS (SELECT o_custkey, o_orderkey, 'V' || substring('abc', (o_orderkey // 2 % 3 + 1)::INT, 1) || 't.' AS short, year(o_orderdate) || '. évi X. törvény' AS named FROM orders),
      d AS (SELECT * FROM o WHERE o_orderkey % 2 = 0), u AS (SELECT u.o_orderkey, coalesce(d.named, u.short) AS act FROM (SELECT * FROM o WHERE o_orderkey % 2 = 1) u ASOF LEFT JOIN d ON u.o_custkey = d.o_custkey AND u.short = d.short AND u.o_orderkey >= d.o_orderkey)
      SELECT o_orderkey::VARCHAR AS o_orderkey, 15::BIGINT AS start_pos, (15 + length(named))::BIGINT AS end_pos, named AS act, NULL AS article_first FROM d
      UNION ALL SELECT o_orderkey::VARCHAR, 2, 6, act, NULL FROM u UNION ALL SELECT o_orderkey::VARCHAR, 7, 13, act, '3' FROM u""",
    "sql_functions": f"""{_WALK} SELECT kind, count(*) AS n FROM n GROUP BY kind UNION ALL SELECT 'order ' || {_ROMAN_4K.replace('{n}', '(o_orderkey % 3999 + 1)')}, count(*) FROM orders GROUP BY 1""",
    "ref_lookup": f"""WITH {_E('btk_mod_1')} SELECT act_id || ' 1 (2)-(3)' AS ref_id, act_id, element_id FROM e WHERE regexp_matches(element_id, '^1_(2([^0-9_][^_]*)?|3)__$')
      UNION ALL SELECT act_id || ' 2', act_id, element_id FROM e WHERE element_id = '2___'""",
}
