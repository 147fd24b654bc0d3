"""Queries of citations, amendments, repeals and enforcement dates.

Orders are written out as sentences of legal prose and read back, so the SQL for comparison needs only their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.numerals import month_name, roman

from lexweave.operators import refs
from lexweave.operators import sentences as S
from lexweave.session import read

K = ["o_orderkey"]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the numbers that their sentences are made of."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    n = lambda by, most: (F.pmod(F.floor(F.col("o_orderkey") / by), F.lit(most)) + 1).cast("int")
    o = o.withColumns({"article": n(1, 200), "paragraph": n(3, 12), "kind": F.pmod("o_orderkey", F.lit(4))})
    act = F.concat(F.year("d"), F.lit(". évi "), roman((F.pmod("o_custkey", F.lit(300)) + 1).cast("int")), F.lit(". törvény"))
    return o.withColumn("act", act).withColumn("letter", F.substring(F.lit("abcdefghijklm"), n(7, 13), F.lit(1)))


def _found(spark: SparkSession, sf_dir: str, sentence: Column) -> DataFrame:
    o = _orders(spark, sf_dir)
    return S.analyze_sentences(o.withColumn("sentence", sentence), K, "sentence")


def _s(template: str) -> Column:
    """A sentence with the columns named in braces."""
    parts = []
    for i, x in enumerate(template.replace("}", "{").split("{")):
        parts.append(F.col(x).cast("string") if i % 2 else F.lit(x))
    return F.concat(*parts)


def enforcement_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as enforcing sentences: on a day, some days after publication, in a month after it, or an article on a day."""
    day = F.concat(F.year("d"), F.lit(". "), month_name(F.month("d")), F.lit(" "), F.day("d"), F.lit("-án"))
    sentence = F.when(F.col("kind") == 0, F.concat(F.lit("Ez a törvény – a (2) bekezdésben foglalt kivétellel – "), day, F.lit(" lép hatályba."))).when(F.col("kind") == 1, _s("Ez a törvény a kihirdetését követő {paragraph}. napon lép hatályba.")).when(F.col("kind") == 2, _s("Ez a törvény a kihirdetését követő második hónap {paragraph}. napján lép hatályba.")).otherwise(F.concat(_s("A {article}. § ({paragraph}) bekezdése "), day, F.lit(" lép hatályba, és "), day, F.lit(" hatályát veszti.")))
    r = S.records(_found(spark, sf_dir, sentence), K, "EnforcementDate")
    return r.select("o_orderkey", "date_kind", F.col("exact_date").cast("string").alias("exact_date"), F.col("days").cast("string").alias("days"), F.col("day").cast("string").alias("day"), F.col("months").cast("string").alias("months"), "article_first", "paragraph_last", F.col("repeal_date").cast("string").alias("repeal_date"))


def element_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in prose: lists that join, lists that don't, ranges; with their places in the sentence."""
    sentence = F.when(F.col("kind") < 2, _s("Az eljárásra a {act} {article}. § ({paragraph}) bekezdés {letter}) pontja és a 7–9. § irányadó.")).otherwise(_s("A {act} {article}. § (2), (3) és (9) bekezdése szerint jár el."))
    c = S.citations(_found(spark, sf_dir, sentence), K)
    return c.select("o_orderkey", F.col("seq").cast("bigint").alias("seq"), F.col("start_pos").cast("bigint").alias("start_pos"), F.col("end_pos").cast("bigint").alias("end_pos"), "act", "article_first", "article_last", "paragraph_first", "paragraph_last", "point_first")


def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names that sentences give to acts."""
    sentence = F.when(F.col("kind") == 0, _s("A vízről szóló {act} (a továbbiakban: Vgt.) szerint kell eljárni.")).when(F.col("kind") == 1, _s("A vízről szóló {act} (a továbbiakban: Víziközmű tv.) {article}. §-a helyébe a következő rendelkezés lép:")).otherwise(_s("A vízről szóló {act} szerint kell eljárni."))
    return S.abbreviations(_found(spark, sf_dir, sentence), K).select("o_orderkey", "abbreviation", "act")


def block_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements replaced, inserted, both at once, or subtitles put before an article."""
    sentence = (
        F.when(F.col("kind") == 0, _s("A vízről szóló {act} (a továbbiakban: Vgt.) {article}. § ({paragraph}) bekezdése helyébe a következő rendelkezés lép:"))
        .when(F.col("kind") == 1, _s("A vízről szóló {act} {article}. §-a a következő ({paragraph}a) bekezdéssel egészül ki:"))
        .when(F.col("kind") == 2, _s("A Vgt. {article}. § (1) és (2) bekezdése helyébe a következő rendelkezések lépnek, és a § a következő (3) bekezdéssel egészül ki:"))
        .otherwise(_s("A Vgt. a következő alcímmel és {article}/A. §-sal egészül ki:"))
    )
    r = S.records(_found(spark, sf_dir, sentence), K, "BlockAmendment")
    return r.select("o_orderkey", "act", "article_first", "paragraph_first", "paragraph_last", "special_position", "special_article", "pure_insertion")


def heading_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, chapters and subtitles replaced, and titles inserted into a book."""
    sentence = (
        F.when(F.col("kind") == 0, F.concat(F.lit("A Vgt. "), roman(F.col("article")), F.lit(". Fejezete helyébe a következő fejezet lép:")))
        .when(F.col("kind") == 1, F.concat(_s("A {act} Harmadik Könyve a következő "), roman(F.col("article")), F.lit(". Címmel egészül ki:")))
        .when(F.col("kind") == 2, F.concat(F.lit("A Vgt. Hatodik Könyv "), roman(F.col("article")), F.lit(". Címe helyébe a következő cím lép:")))
        .otherwise(_s("A Vgt. {article}. alcíme helyébe a következő rendelkezés lép:"))
    )
    r = S.records(_found(spark, sf_dir, sentence), K, "BlockAmendment")
    return r.select("o_orderkey", "act", "book", "title", "chapter", "subtitle")


def text_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wordings replaced in several places: every place with every pair."""
    sentence = _s("A {act} {article}. § ({paragraph}) bekezdésében és 3:{article}. § {letter}) pontjában az „a {paragraph} „régi” szó” szövegrész helyébe az „új {letter}” szöveg, a „másik” szövegrészek helyébe a „harmadik” szöveg lép.")
    r = S.records(_found(spark, sf_dir, sentence), K, "TextAmendment")
    return r.select("o_orderkey", "act", "article_first", "paragraph_first", "point_first", "original_text", "replacement_text")


def title_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentence = _s("A {act} {article}. § címében a „régi {letter}” szövegrész helyébe az „új {letter}” szöveg lép.")
    r = S.records(_found(spark, sf_dir, sentence), K, "ArticleTitleAmendment")
    return r.select("o_orderkey", "act", "article_first", "original_text", "replacement_text")


def repeals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements, wordings and headings repealed."""
    sentence = F.when(F.col("kind") < 2, _s("Hatályát veszti a {act} {article}. § ({paragraph}) bekezdése és {letter}) pontjában az „egy”, valamint a „kettő” szövegrész.")).when(F.col("kind") == 2, _s("Hatályát veszti a {act} {article}. § {letter}) pontja.")).otherwise(_s("Nem lép hatályba a Vgt. {article}. §-át megelőző alcíme."))
    r = S.records(_found(spark, sf_dir, sentence), K, "Repeal")
    return r.select("o_orderkey", "act", "article_first", "paragraph_first", "point_first", "special_position", "special_article", "text")


def act_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts named by number in all subpoints, found without Python."""
    return S.act_mentions(read(spark, sf_dir, "subpoints"), ["row_id"], "text").select("row_id", F.col("pos").cast("bigint").alias("pos"), "act")


def subpoint_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every citation in the wordings of all subpoints."""
    return S.citations(S.analyze_sentences(read(spark, sf_dir, "subpoints"), ["row_id"], "text"), ["row_id"])


def abbrev_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of even number define a customer's abbreviation, those of odd number use it: the last definition before a use holds."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("act_id"), F.concat(F.lit("A"), F.pmod(F.floor(F.col("o_orderkey") / 2), F.lit(3))).alias("abbreviation"), "o_orderkey")
    definitions = o.where("o_orderkey % 2 = 0").withColumn("act", F.concat(F.lit("törvény "), F.col("o_orderkey")))
    return S.resolve_abbreviations(o.where("o_orderkey % 2 = 1"), definitions, "o_orderkey").select("o_orderkey", "abbreviation", "target_act")


def ref_relative_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a chain of references that leave out what the ones before said."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    k = F.pmod("p", F.lit(3))
    s = F.col("p").cast("string")
    r = refs.ref(None, article=refs.level(F.when(k == 0, s)), paragraph=refs.level(F.when(k <= 1, s)), point=refs.level(F.when(k >= 1, s)))
    c = refs.chain(li, ["l_orderkey"], ["l_linenumber"], r)
    return c.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.col("resolved.article.first").alias("article"), F.col("resolved.paragraph.first").alias("paragraph"), F.col("resolved.point.first").alias("point"), refs.id_string(F.col("resolved")).alias("id_string"))


QUERIES = {f.__name__: f for f in (enforcement_dates, element_references, abbreviations, block_amendments, heading_amendments, text_amendments, title_amendments, repeals, act_references, subpoint_citations, abbrev_asof, ref_relative_chain)}

_ROMAN = lambda n: "(repeat('C', ({n}) // 100 % 10) || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][({n}) // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][({n}) % 10 + 1])".replace("{n}", n)
_O = f"""o AS (SELECT o_orderkey, o_orderkey % 4 AS kind, o_orderdate::DATE AS d, (o_orderkey % 200 + 1)::VARCHAR AS article, (o_orderkey // 3 % 12 + 1)::VARCHAR AS paragraph,
  substring('abcdefghijklm', (o_orderkey // 7 % 13 + 1)::INT, 1) AS letter, year(o_orderdate) || '. évi ' || {_ROMAN('(o_custkey % 300 + 1)')} || '. törvény' AS act FROM orders)"""
SQL = {
    "enforcement_dates": f"""WITH {_O} SELECT o_orderkey, CASE WHEN kind IN (0, 3) THEN 'Date' WHEN kind = 1 THEN 'DaysAfterPublication' ELSE 'DayInMonthAfterPublication' END AS date_kind,
      CASE WHEN kind IN (0, 3) THEN d::VARCHAR END AS exact_date, CASE WHEN kind = 1 THEN paragraph END AS days, CASE WHEN kind = 2 THEN paragraph END AS day, CASE WHEN kind = 2 THEN '2' END AS months,
      CASE WHEN kind = 3 THEN article END AS article_first, CASE WHEN kind = 3 THEN paragraph END AS paragraph_last, CASE WHEN kind = 3 THEN d::VARCHAR END AS repeal_date FROM o""",
    "element_references": f"""WITH {_O}, s AS (SELECT *, CASE WHEN kind < 2 THEN 'Az eljárásra a ' || act || ' ' || article || '. § (' || paragraph || ') bekezdés ' || letter || ') pontja és a 7–9. § irányadó.' ELSE 'A ' || act || ' ' || article || '. § (2), (3) és (9) bekezdése szerint jár el.' END AS t FROM o),
      p AS (SELECT *, (strpos(t, act) - 1)::BIGINT AS a, (strpos(t, act) + length(act))::BIGINT AS b FROM s)
      SELECT o_orderkey, 0::BIGINT AS seq, a AS start_pos, a + length(act) AS end_pos, act, NULL AS article_first, NULL AS article_last, NULL AS paragraph_first, NULL AS paragraph_last, NULL AS point_first FROM p
      UNION ALL SELECT o_orderkey, 1, b, strpos(t, ' és a 7') - 1, act, article, article, paragraph, paragraph, letter FROM p WHERE kind < 2
      UNION ALL SELECT o_orderkey, 2, strpos(t, '7–9') - 1, strpos(t, ' irányadó') - 1, act, '7', '9', NULL, NULL, NULL FROM p WHERE kind < 2
      UNION ALL SELECT o_orderkey, 1, b, strpos(t, '(3)') + 2, act, article, article, '2', '3', NULL FROM p WHERE kind >= 2
      UNION ALL SELECT o_orderkey, 2, strpos(t, '(9)') - 1, strpos(t, ' szerint') - 1, act, article, article, '9', '9', NULL FROM p WHERE kind >= 2""",
    "abbreviations": f"WITH {_O} SELECT o_orderkey, CASE kind WHEN 0 THEN 'Vgt.' ELSE 'Víziközmű tv.' END AS abbreviation, act FROM o WHERE kind < 2",
    "block_amendments": f"""WITH {_O} SELECT o_orderkey, CASE WHEN kind < 2 THEN act ELSE 'Vgt.' END AS act, CASE WHEN kind < 3 THEN article END AS article_first, CASE kind WHEN 0 THEN paragraph WHEN 1 THEN paragraph || 'a' WHEN 2 THEN '1' END AS paragraph_first,
      CASE kind WHEN 0 THEN paragraph WHEN 1 THEN paragraph || 'a' WHEN 2 THEN '3' END AS paragraph_last, CASE WHEN kind = 3 THEN 'BEFORE_WITH_ARTICLE' END AS special_position, CASE WHEN kind = 3 THEN article || '/A' END AS special_article, kind IN (1, 3) AS pure_insertion FROM o""",
    "heading_amendments": f"WITH {_O} SELECT o_orderkey, CASE WHEN kind = 1 THEN act ELSE 'Vgt.' END AS act, CASE kind WHEN 1 THEN '3' WHEN 2 THEN '6' END AS book, CASE WHEN kind IN (1, 2) THEN article END AS title, CASE WHEN kind = 0 THEN article END AS chapter, CASE WHEN kind = 3 THEN article END AS subtitle FROM o",
    "text_amendments": f"""WITH {_O}, r AS (SELECT o_orderkey, act, letter, paragraph AS p, article AS article_first, paragraph AS paragraph_first, NULL AS point_first FROM o UNION ALL SELECT o_orderkey, act, letter, paragraph, '3:' || article, NULL, letter FROM o)
      SELECT o_orderkey, act, article_first, paragraph_first, point_first, 'a ' || p || ' „régi” szó' AS original_text, 'új ' || letter AS replacement_text FROM r UNION ALL SELECT o_orderkey, act, article_first, paragraph_first, point_first, 'másik', 'harmadik' FROM r""",
    "title_amendments": f"WITH {_O} SELECT o_orderkey, act, article AS article_first, 'régi ' || letter AS original_text, 'új ' || letter AS replacement_text FROM o",
    "repeals": f"""WITH {_O}, t AS (SELECT unnest(['egy', 'kettő']) AS text)
      SELECT o_orderkey, act, article AS article_first, paragraph AS paragraph_first, NULL AS point_first, NULL AS special_position, NULL AS special_article, text FROM o, t WHERE kind < 2
      UNION ALL SELECT o_orderkey, act, article, paragraph, letter, NULL, NULL, text FROM o, t WHERE kind < 2
      UNION ALL SELECT o_orderkey, act, article, NULL, letter, NULL, NULL, NULL FROM o WHERE kind = 2
      UNION ALL SELECT o_orderkey, 'Vgt.', NULL, NULL, NULL, 'BEFORE_WITHOUT_ARTICLE', article, NULL FROM o WHERE kind = 3""",
    "act_references": "WITH m AS (SELECT row_id, regexp_extract_all(text, '([0-9]+\\. ?évi [IVXLCDM]+\\. ?törvény)', 1) AS a FROM subpoints WHERE text IS NOT NULL) SELECT row_id, unnest(range(len(a)))::BIGINT AS pos, unnest(a) AS act FROM m",
    "abbrev_asof": """WITH o AS (SELECT o_custkey, 'A' || (o_orderkey // 2 % 3) AS abbreviation, o_orderkey FROM orders)
      SELECT u.o_orderkey, u.abbreviation, CASE WHEN d.o_orderkey IS NOT NULL THEN 'törvény ' || d.o_orderkey END AS target_act FROM (SELECT * FROM o WHERE o_orderkey % 2 = 1) u ASOF LEFT JOIN (SELECT * FROM o WHERE o_orderkey % 2 = 0) d ON u.o_custkey = d.o_custkey AND u.abbreviation = d.abbreviation AND u.o_orderkey >= d.o_orderkey""",
    "ref_relative_chain": """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), f AS (SELECT *, p % 3 AS k, p::VARCHAR AS s FROM l),
      w AS (SELECT l_orderkey, l_linenumber, last_value(CASE WHEN k = 0 THEN s END IGNORE NULLS) OVER x AS article, last_value(CASE WHEN k <= 1 THEN s END IGNORE NULLS) OVER x AS paragraph, CASE WHEN k >= 1 THEN s END AS point FROM f WINDOW x AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
      SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, article, paragraph, point, coalesce(article, '') || '_' || coalesce(paragraph, '') || '_' || coalesce(point, '') || '_' AS id_string FROM w""",
}
