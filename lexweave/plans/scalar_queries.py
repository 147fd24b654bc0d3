"""Queries of numerals, dates and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import dates, identifiers, numerals, text
from lexweave.kernels.identifiers import HUNGARIAN_STEPS
from lexweave.kernels.numerals import MONTHS, ONES, ONES_IN_COMPOUNDS, TENS, TENS_IN_COMPOUNDS
from lexweave.session import read


def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's number in Roman and back, with a postfix."""
    n = (F.pmod("o_orderkey", F.lit(3999)) + 1).cast("bigint")
    o = read(spark, sf_dir, "orders").select("o_orderkey", n.alias("n")).withColumn("roman", numerals.roman(F.col("n")))
    return o.withColumn("back", numerals.roman_value(F.col("roman")).cast("bigint")).withColumn("with_postfix", numerals.roman_to_arabic(F.concat("roman", F.lit("/A"))))


def act_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year and number of every act."""
    p = r"^([0-9]{4})\. évi ([IVXLCDM]+)\. törvény$"
    a = read(spark, sf_dir, "raw_acts").where(F.col("act_id").rlike(p))
    return a.select("act_id", F.regexp_extract("act_id", p, 1).cast("bigint").alias("year"), numerals.roman_value(F.regexp_extract("act_id", p, 2)).cast("bigint").alias("number"))


def hun_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts, and what they lack to a hundred, as ordinal words and back."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.col("p_size"), 101 - F.col("p_size"))).alias("n"))
    return p.select("p_partkey", F.col("n").cast("bigint").alias("n"), numerals.ordinal_word(F.col("n")).alias("word"), numerals.ordinal_value(F.upper(numerals.ordinal_word(F.col("n")))).cast("bigint").alias("back"))


def hun_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written out and short, and read back."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    long = F.concat(F.year("d"), F.lit(". "), numerals.month_name(F.month("d")), F.lit(" "), F.day("d"), F.lit("., kedd"))
    return o.select("o_orderkey", long.alias("written"), dates.hungarian_date(long).cast("string").alias("long_date"), dates.simple_date(F.date_format("d", "y.M.d.")).cast("string").alias("short_date"), dates.simple_date(F.date_format("d", "y/M/d")).cast("string").alias("slash_date"))


def date_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts' publication dates and the days on which they come into force by various rules."""
    a = read(spark, sf_dir, "raw_acts")
    return a.select("act_id", F.date_add("publication_date", 8).cast("string").alias("eighth_day"), F.add_months(F.trunc("publication_date", "month"), 1).cast("string").alias("first_of_next_month"))


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of every article identifier of an act in natural order."""
    a = read(spark, sf_dir, "btk_mod_1").where("kind = 'Article' AND identifier IS NOT NULL").select("act_id", "identifier").distinct()
    w = Window.partitionBy("act_id").orderBy(identifiers.natural_key(F.col("identifier")))
    return a.select("act_id", "identifier", F.row_number().over(w).cast("bigint").alias("rank"))


def id_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring siblings, and whether the second's identifier follows the first's."""
    e = read(spark, sf_dir, "btk_mod_1").where("identifier IS NOT NULL AND kind IN ('Paragraph', 'NumericPoint', 'AlphabeticPoint', 'NumericSubpoint')").select("act_id", "parent_id", "kind", "ord", "identifier").distinct()
    w = Window.partitionBy("act_id", "parent_id", "kind").orderBy("ord", "identifier")
    near = e.withColumn("before", F.lag("identifier").over(w)).where("before IS NOT NULL")
    return near.select("act_id", "parent_id", "kind", "before", "identifier", identifiers.next_identifier(F.col("kind"), F.col("before"), F.col("identifier")).alias("follows"))


def header_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "dashes")
    return e.select("row_id", identifiers.header_prefix(F.col("kind"), F.col("identifier")).alias("prefix"))


def list_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as sentences of their own."""
    e = read(spark, sf_dir, "btk_mod_1").where("text IS NOT NULL")
    return e.select("row_id", text.fix_list_end(F.col("text")).alias("sentence"))


QUERIES = {f.__name__: f for f in (roman_numerals, act_numbers, hun_ordinals, hun_dates, date_shift, natural_order, id_successors, header_prefixes, list_ends)}


def _roman_sql(n: str) -> str:
    digits = (("M", "", "", 1000), ("C", "D", "M", 100), ("X", "L", "C", 10), ("I", "V", "X", 1))
    out = []
    for one, five, ten, unit in digits:
        d = f"(({n}) // {unit} % 10)"
        if unit == 1000:
            out.append(f"repeat('M', ({n}) // 1000)")
        else:
            out.append(f"CASE WHEN {d} = 9 THEN '{one}{ten}' WHEN {d} >= 5 THEN '{five}' || repeat('{one}', {d} - 5) WHEN {d} = 4 THEN '{one}{five}' ELSE repeat('{one}', {d}) END")
    return " || ".join(f"({x})" for x in out)


_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_VALUE = "list_sum(list_transform(list_zip(d, list_append(d[2:], 0)), lambda p: CASE WHEN p[1] < p[2] THEN -p[1] ELSE p[1] END))"
_STEPS = ", ".join(f"'{a}>{b}'" for a, b in HUNGARIAN_STEPS)
_NEXT_LETTER = lambda a, b: f"(({a} || '>' || {b}) IN ({_STEPS}) OR (length({a}) = 1 AND length({b}) = 1 AND unicode({b}) = unicode({a}) + 1))"
SQL = {
    "roman_numerals": f"WITH o AS (SELECT o_orderkey, (o_orderkey % 3999 + 1)::BIGINT AS n FROM orders) SELECT o_orderkey, n, {_roman_sql('n')} AS roman, n AS back, n::VARCHAR || '/A' AS with_postfix FROM o",
    "act_numbers": f"""WITH a AS (SELECT act_id, regexp_extract(act_id, '^([0-9]{{4}})', 1)::BIGINT AS year, regexp_extract(act_id, 'évi ([IVXLCDM]+)\\.', 1) AS r FROM raw_acts WHERE regexp_matches(act_id, '^([0-9]{{4}})\\. évi ([IVXLCDM]+)\\. törvény$')),
      d AS (SELECT act_id, year, list_transform(string_split(r, ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 ELSE 1000 END) AS d FROM a)
      SELECT act_id, year, {_VALUE}::BIGINT AS number FROM d""",
    "hun_ordinals": f"""WITH p AS (SELECT p_partkey, unnest([p_size, 101 - p_size])::BIGINT AS n FROM part)
      SELECT p_partkey, n, CASE WHEN n = 100 THEN 'századik' WHEN n < 10 THEN {_list(ONES)}[n] WHEN n % 10 = 0 THEN {_list(TENS)}[n // 10] ELSE {_list(TENS_IN_COMPOUNDS)}[n // 10] || {_list(ONES_IN_COMPOUNDS)}[n % 10] END AS word, n AS back FROM p""",
    "hun_dates": f"SELECT o_orderkey, year(o_orderdate) || '. ' || {_list(MONTHS)}[month(o_orderdate)] || ' ' || day(o_orderdate) || '., kedd' AS written, o_orderdate::DATE::VARCHAR AS long_date, o_orderdate::DATE::VARCHAR AS short_date, o_orderdate::DATE::VARCHAR AS slash_date FROM orders",
    "date_shift": "SELECT act_id, (publication_date + 8)::DATE::VARCHAR AS eighth_day, (date_trunc('month', publication_date) + INTERVAL 1 MONTH)::DATE::VARCHAR AS first_of_next_month FROM raw_acts",
    "natural_order": "WITH a AS (SELECT DISTINCT act_id, identifier FROM btk_mod_1 WHERE kind = 'Article' AND identifier IS NOT NULL) SELECT act_id, identifier, row_number() OVER (PARTITION BY act_id ORDER BY regexp_extract(identifier, '^([0-9]+)', 1)::INT, regexp_extract(identifier, '^[0-9]+(.*)$', 1))::BIGINT AS rank FROM a",
    "id_successors": f"""WITH e AS (SELECT DISTINCT act_id, parent_id, kind, ord, identifier FROM btk_mod_1 WHERE identifier IS NOT NULL AND kind IN ('Paragraph', 'NumericPoint', 'AlphabeticPoint', 'NumericSubpoint')),
      n AS (SELECT *, lag(identifier) OVER (PARTITION BY act_id, parent_id, kind ORDER BY ord, identifier) AS before FROM e),
      x AS (SELECT *, try_cast(regexp_extract(before, '^([0-9]+)/?([a-zA-Z]*)$', 1) AS BIGINT) AS a, regexp_extract(before, '^([0-9]+)/?([a-zA-Z]*)$', 2) AS la, try_cast(regexp_extract(identifier, '^([0-9]+)/?([a-zA-Z]*)$', 1) AS BIGINT) AS b, regexp_extract(identifier, '^([0-9]+)/?([a-zA-Z]*)$', 2) AS lb FROM n WHERE before IS NOT NULL)
      SELECT act_id, parent_id, kind, before, identifier, CASE WHEN kind = 'AlphabeticPoint' THEN {_NEXT_LETTER('before', 'identifier')} WHEN b = a + 1 THEN lb = '' WHEN b = a AND la = '' THEN lb IN ('a', 'A') WHEN b = a THEN {_NEXT_LETTER('la', 'lb')} ELSE false END AS follows FROM x""",
    "header_prefixes": "SELECT row_id, CASE WHEN identifier IS NULL THEN '' WHEN kind = 'Paragraph' THEN '(' || identifier || ') ' WHEN kind IN ('NumericPoint', 'NumericSubpoint') THEN identifier || '. ' WHEN kind IN ('AlphabeticPoint', 'AlphabeticSubpoint') THEN identifier || ') ' WHEN kind = 'Article' THEN identifier || '. §' ELSE '' END AS prefix FROM dashes",
    "list_ends": "WITH s AS (SELECT row_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ' és$', ''), ' valamint$', ''), ' illetve$', ''), ' vagy$', ''), ';$', ''), ',$', '') AS s FROM btk_mod_1 WHERE text IS NOT NULL) SELECT row_id, CASE WHEN regexp_matches(s, '[.:!?]$') THEN s ELSE s || '.' END AS sentence FROM s",
}
