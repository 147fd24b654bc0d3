"""Queries over lines: plain text, glyphs, HTML, gazettes, patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions.text import join_lines
from lexweave.operators import fixups, gazette
from lexweave.operators.scans import previous, running_sum
from lexweave.session import read
from lexweave.sources.lines import glyph_lines, html_texts, issue_file, text_lines, with_quote_change

LINES_SQL = """l AS (SELECT doc_id, unnest(range(len(a)))::BIGINT AS line_no, unnest(a) AS raw FROM (
  SELECT doc_id, string_split(replace(replace(replace(replace(text, chr(13), ''), '<BOLD>', '      '), '<NJ>', '    '), chr(9), ' '), chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
lines AS (SELECT doc_id, line_no, regexp_replace(trim(raw, ' '), ' +', ' ', 'g') AS content,
  CASE WHEN trim(raw, ' ') = '' THEN 0.0 ELSE 5.0 * (length(raw) - length(ltrim(raw, ' ')) + 2) END::DOUBLE AS indent FROM l)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(read(spark, sf_dir, "documents"), "doc_id", "text")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "content", "indent")


def line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document as running text; every third line is made to end in a hyphen."""
    hyphened = F.transform(F.split(F.regexp_replace("text", "\r", ""), "\n"), lambda x, i: F.when(i % 3 == 2, F.concat(x, F.lit("-"))).otherwise(x))
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(join_lines(hyphened)).alias("joined_md5"), F.length(join_lines(hyphened)).cast("bigint").alias("joined_chars"))


def quote_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quote level before every line that opens or closes a quote."""
    changed = with_quote_change(_lines(spark, sf_dir))
    levels = running_sum(changed, ["doc_id"], "line_no", F.col("quote_change"), "quote_level", inclusive=False)
    return levels.where("content RLIKE '[„“”]'").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("quote_level").cast("bigint").alias("quote_level"))


def quote_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose quotes aren't balanced."""
    changed = with_quote_change(_lines(spark, sf_dir))
    levels = running_sum(changed, ["doc_id"], "line_no", F.col("quote_change"), "level_after")
    by = levels.groupBy("doc_id").agg(F.min("level_after").cast("bigint").alias("lowest"), F.sum("quote_change").cast("bigint").alias("final"))
    return by.where("lowest < 0 OR final <> 0")


def prev_line_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article headers after an empty line."""
    near = previous(_lines(spark, sf_dir), ["doc_id"], "line_no", ["is_empty"])
    p = r"^(([0-9]+:)?([0-9]+(/[A-Z])?))\. ?§ +(.*)$"
    return near.where(F.col("content").rlike(p) & F.col("prev_is_empty")).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.regexp_extract("content", p, 1).alias("identifier"))


def html_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts between the tags of documents that hold HTML."""
    docs = read(spark, sf_dir, "documents").where(F.col("text").contains("<"))
    return html_texts(docs, "doc_id", "text").select(F.col("page_id").alias("doc_id"), F.col("pos").cast("bigint").alias("pos"), "tag", "text")


def issue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", issue_file(F.year("o_orderdate"), F.pmod("o_custkey", F.lit(200)) + 1).alias("file"))


def glyphs_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts drawn as pages of single characters, the name above and the brand below, and read back as lines."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    drawn = lambda c, y: F.transform(F.split(F.col(c), ""), lambda ch, i: F.struct(ch.alias("content"), (i * 5.0 + 50.0).alias("x"), F.lit(y).alias("y")))
    boxes = part.select(F.lit("parts").alias("issue_id"), F.col("p_partkey").alias("page_no"), F.inline(F.concat(drawn("p_name", 700.0), drawn("p_brand", 650.0))))
    full = boxes.withColumns({"width": F.lit(5.0), "width_of_space": F.lit(4.0), "bold": F.lit(False)})
    return glyph_lines(full).select(F.col("page_no").alias("p_partkey"), F.col("line_no").cast("bigint").alias("line_no"), "content", "indent", "margin_right")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of a customer's gazette: open ones begin the section of laws, finished ones that of decisions."""
    o = read(spark, sf_dir, "orders")
    heading = F.when(F.col("o_orderstatus") == "O", F.lit(gazette.LAWS)).when(F.col("o_orderstatus") == "F", F.lit(gazette.SECTIONS[-1]))
    lines = F.array_compact(F.array(heading, F.concat(F.lit("szöveg "), F.col("o_orderkey"))))
    return o.select(F.col("o_custkey").alias("issue_id"), F.col("o_orderkey").alias("page_no"), F.posexplode(lines).alias("line_no", "content"))


def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = gazette.section_lines(_pages(spark, sf_dir)).where("content <> ''")
    return s.select(F.col("issue_id").alias("o_custkey"), F.col("page_no").alias("o_orderkey"), F.col("section_no").cast("bigint").alias("section_no"), "section")


def act_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts printed one after another as pages of the section of laws, and cut out again."""
    acts = read(spark, sf_dir, "raw_acts").withColumn("subject", F.coalesce("subject", F.lit("tárgy nélkül")))
    body = F.array(F.lit(gazette.LAWS), F.lit("fejléc"), F.lit(""), F.col("act_id"), F.concat("subject", F.lit("*")), F.lit("1. § Egy."), F.lit("2. § Kettő."), F.lit(""), F.lit("* Elfogadva."), F.lit(""), F.lit("3. § Három."), F.lit(""), F.lit("A, B"), F.lit("köztársasági elnök az Országgyűlés elnöke"))
    lines = acts.select(F.substring("act_id", 1, 4).alias("issue_id"), F.xxhash64("act_id").alias("page_no"), F.posexplode(body).alias("line_no", "content"))
    issues = acts.select(F.substring("act_id", 1, 4).alias("issue_id")).distinct().withColumn("publication_date", F.lit(None).cast("date"))
    cut = gazette.act_lines(gazette.section_lines(lines), issues)
    return cut.groupBy("act_id", "subject").agg(F.count("*").alias("n_lines"), F.max_by("content", "line_no").alias("last_line"), F.min("complete").alias("complete"))


def _gazettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The acts as gazettes: an issue a year, its first page with title and date, then a page for each act with the page's two header lines."""
    acts = read(spark, sf_dir, "raw_acts").where("act_id RLIKE '^[12][09][0-9][0-9]. évi [IVXLC]+. törvény$'").withColumn("issue_id", F.substring("act_id", 1, 4))
    years = acts.select("issue_id").distinct()
    title = F.array(*map(F.lit, (gazette.TITLE_WORDS, "1. szám", "")), F.concat("issue_id", F.lit(". március 15., péntek")), F.lit(""), F.lit(gazette.SECTIONS[0]))
    body = F.array(F.lit("12"), F.lit("fejléc"), F.lit(gazette.LAWS), F.lit("fejléc"), F.lit(""), F.col("act_id"), F.concat(F.coalesce("subject", F.lit("tárgy nélkül")), F.lit("*")), F.lit("1. §   Egy."), F.lit("2. §   A Vgt. 3. §-a szerint jár el."), F.lit(""), F.lit("* Elfogadva."), F.lit(""), F.lit("3. §   Három."), F.lit(""), F.lit("A, B"), F.lit("köztársasági elnök az Országgyűlés elnöke"))
    numbered = acts.withColumn("page_no", F.row_number().over(Window.partitionBy("issue_id").orderBy("act_id")) + 1)
    pages = numbered.select("issue_id", "page_no", F.posexplode(body).alias("line_no", "content"))
    return years.select("issue_id", F.lit(1).alias("page_no"), F.posexplode(title).alias("line_no", "content")).unionByName(pages)


def gazette_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the lines of gazettes to acts: cut out, parsed, analysed and written as text."""
    from lexweave.plans import pipeline
    from lexweave.sinks import render

    made = pipeline.run(_gazettes(spark, sf_dir))
    header = made.acts.select("act_id", F.col("publication_date").cast("string").alias("publication_date"), "subject").distinct()
    cited = made.semantics.citations.groupBy("act_id").agg(F.count("*").alias("citations"))
    return header.join(render.txt(made.elements), "act_id").join(cited, "act_id").select("act_id", "publication_date", "subject", "citations", "txt")


def _patched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = _lines(spark, sf_dir).select(F.col("doc_id").alias("act_id"), "line_no", "content")
    kind = F.element_at(F.array(F.lit("replace"), F.lit("delete"), F.lit("empty_after")), (F.pmod("act_id", F.lit(3)) + 1).cast("int"))
    patches = lines.where("line_no = 0").select("act_id", F.lit(1).alias("seq"), kind.alias("op"), F.col("content").alias("needle"), F.lit("JAVÍTVA").alias("replacement"), F.array().cast("array<string>").alias("prev_lines"))
    return lines, patches


def fixup_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of every document replaced, deleted or followed by an empty line; lines and changes per document."""
    out = fixups.apply_fixups(*_patched(spark, sf_dir))
    return out.groupBy(F.col("act_id").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.sum((F.col("content") == "JAVÍTVA").cast("bigint")).alias("replaced"), F.sum((F.col("sub_no") > 0).cast("bigint")).alias("added"))


def fixup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose first line stands there more than once, so that its patch can't be applied."""
    return fixups.failed_fixups(*_patched(spark, sf_dir)).select(F.col("act_id").alias("doc_id"), "hits")


def fixup_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document that equals an earlier one, edited: patches with the least context, per document and length of context."""
    lines = _lines(spark, sf_dir).select(F.col("doc_id").alias("act_id"), "line_no", "content")
    edited = lines.withColumn("content", F.when(F.pmod("line_no", F.lit(5)) == 4, F.concat("content", F.lit(" (javítva)"))).otherwise(F.col("content")))
    made = fixups.make_fixups(lines, edited)
    return made.groupBy(F.col("act_id").alias("doc_id"), F.coalesce(F.size("prev_lines"), F.lit(-1)).cast("bigint").alias("context")).agg(F.count("*").alias("n"))


def fixup_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four patches of every document, each of which needs what the one before it made; the lines after them, and how many failed."""
    lines = _lines(spark, sf_dir).select(F.col("doc_id").alias("act_id"), "line_no", "content")
    first = F.col("content")
    patch = lambda seq, op, needle, new, *before: F.struct(F.lit(seq).alias("seq"), F.lit(op).alias("op"), needle.alias("needle"), F.lit(new).alias("replacement"), F.array(*map(F.lit, before)).cast("array<string>").alias("prev_lines"))
    steps = F.array(patch(1, "replace", first, "EGY"), patch(2, "replace", F.lit("EGY"), "KETTŐ"), patch(3, "empty_after", F.lit("KETTŐ"), None), patch(4, "replace", F.lit(""), "HÁROM", "KETTŐ"))
    patches = lines.where("line_no = 0").select("act_id", F.inline(steps))
    out = fixups.apply_fixups(lines, patches).groupBy("act_id").agg(F.count("*").alias("n_lines"), F.max_by("content", -(F.col("line_no").cast("bigint") * 10 + F.col("sub_no"))).alias("first_line"), F.sum((F.col("content") == "HÁROM").cast("bigint")).alias("added"))
    failed = fixups.failed_fixups(lines, patches).groupBy("act_id").agg(F.count("*").alias("failed"))
    return out.join(failed, "act_id", "left").select(F.col("act_id").alias("doc_id"), "n_lines", "first_line", "added", F.coalesce("failed", F.lit(0)).alias("failed"))


def issue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every year's issues (order days stand for them), those before the first that is missing."""
    from lexweave.sources.lines import until_missing

    o = read(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("bigint").alias("year"), (F.pmod("o_custkey", F.lit(400)) + 1).alias("issue")).distinct()
    return until_missing(o.where("(issue + year) % 97 <> 0"), "year", "issue")


def html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags that every text of a document stands in."""
    from lexweave.sources.lines import html_stack

    docs = read(spark, sf_dir, "documents").where(F.col("text").contains("<"))
    return html_stack(docs, "doc_id", "text").select(F.col("page_id").alias("doc_id"), F.col("pos").cast("bigint").alias("pos"), F.array_join("stack", "/").alias("path"), "text")


QUERIES = {f.__name__: f for f in (doc_lines, line_join, quote_levels, quote_balance, prev_line_headers, html_tokens, issue_files, glyphs_to_lines, section_carry, act_segments, gazette_acts, fixup_apply, fixup_missing, fixup_sequence, fixup_context, issue_scan, html_paths)}
_CHANGES = "length(content) - length(replace(replace(content, '„', ''), '“', '')) - (length(content) - length(replace(content, '”', '')))"
SQL = {
    "doc_lines": f"WITH {LINES_SQL} SELECT * FROM lines",
    "line_join": """WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 = 2 THEN x || '-' ELSE x END), lambda x: x <> '') AS a FROM documents WHERE text IS NOT NULL),
      j AS (SELECT doc_id, CASE WHEN len(a) = 0 THEN '' ELSE list_reduce(a, lambda p, x: CASE WHEN ends_with(p, '-') THEN p || x ELSE p || ' ' || x END) END AS s FROM d)
      SELECT doc_id, md5(s) AS joined_md5, length(s)::BIGINT AS joined_chars FROM j""",
    "quote_levels": f"""WITH {LINES_SQL}, c AS (SELECT *, {_CHANGES} AS d FROM lines), w AS (SELECT doc_id, line_no, content, coalesce(sum(d) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS quote_level FROM c)
      SELECT doc_id, line_no, quote_level FROM w WHERE regexp_matches(content, '[„“”]')""",
    "quote_balance": f"""WITH {LINES_SQL}, c AS (SELECT *, {_CHANGES} AS d FROM lines), w AS (SELECT doc_id, d, sum(d) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM c)
      SELECT doc_id, min(s)::BIGINT AS lowest, sum(d)::BIGINT AS final FROM w GROUP BY doc_id HAVING min(s) < 0 OR sum(d) <> 0""",
    "prev_line_headers": f"""WITH {LINES_SQL}, w AS (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM lines)
      SELECT doc_id, line_no, regexp_extract(content, '^(([0-9]+:)?([0-9]+(/[A-Z])?))\\. ?§ +(.*)$', 1) AS identifier FROM w WHERE p = '' AND regexp_matches(content, '^(([0-9]+:)?([0-9]+(/[A-Z])?))\\. ?§ +(.*)$')""",
    "html_tokens": r"""WITH f AS (SELECT doc_id, regexp_extract_all(text, '<([^>]*)>([^<]*)', 0) AS a FROM documents WHERE contains(text, '<')),
      e AS (SELECT doc_id, unnest(range(len(a)))::BIGINT AS pos, unnest(a) AS raw FROM f),
      t AS (SELECT doc_id, pos, regexp_extract(raw, '^</?([a-zA-Z0-9]*)', 1) AS tag, trim(replace(replace(regexp_replace(raw, '^<[^>]*>', ''), '&nbsp;', ' '), chr(160), ' '), ' ') AS text FROM e) SELECT * FROM t WHERE text <> ''""",
    "issue_files": "SELECT o_orderkey, printf('MK%02d%03d.pdf', (year(o_orderdate) % 100)::INT, (o_custkey % 200 + 1)::INT) AS file FROM orders",
    "glyphs_to_lines": """WITH w AS (SELECT p_partkey, p_name, p_brand, greatest(length(p_name), length(p_brand)) AS n FROM part)
      SELECT p_partkey, 0::BIGINT AS line_no, p_name AS content, 50.0::DOUBLE AS indent, (5.0 * (n - length(p_name)) + 10.0)::DOUBLE AS margin_right FROM w
      UNION ALL SELECT p_partkey, 1, '', 0.0, 0.0 FROM w UNION ALL SELECT p_partkey, 2, p_brand, 50.0, (5.0 * (n - length(p_brand)) + 10.0)::DOUBLE FROM w""",
    "section_carry": f"""WITH p AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'O' THEN '{gazette.LAWS}' WHEN 'F' THEN '{gazette.SECTIONS[-1]}' END AS h FROM orders),
      s AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS section FROM p),
      c AS (SELECT *, CASE WHEN section = lag(section) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 0 ELSE 1 END AS d FROM s),
      n AS (SELECT *, sum(d) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS section_no FROM c) SELECT o_custkey, o_orderkey, section_no, section FROM n WHERE section IS NOT NULL""",
    "act_segments": "SELECT act_id, coalesce(subject, 'tárgy nélkül') AS subject, 4::BIGINT AS n_lines, '3. § Három.' AS last_line, true AS complete FROM raw_acts WHERE regexp_matches(act_id, '^[12][09][0-9][0-9]. évi [IVXLC]+. törvény')",
    "gazette_acts": """SELECT act_id, substring(act_id, 1, 4) || '-03-15' AS publication_date, coalesce(subject, 'tárgy nélkül') AS subject, 2::BIGINT AS citations,
      array_to_string(['1. §', '          Egy.', '2. §', '          A Vgt. 3. §-a szerint jár el.', '3. §', '          Három.'], chr(10)) AS txt FROM raw_acts WHERE regexp_matches(act_id, '^[12][09][0-9][0-9]. évi [IVXLC]+. törvény$')""",
    "fixup_apply": f"""WITH {LINES_SQL}, f AS (SELECT doc_id, content AS needle FROM lines WHERE line_no = 0), h AS (SELECT l.doc_id, count(*) AS hits FROM lines l JOIN f ON l.doc_id = f.doc_id AND l.content = f.needle GROUP BY l.doc_id),
      n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
      SELECT * FROM (SELECT doc_id, (n + CASE WHEN hits = 1 AND doc_id % 3 = 1 THEN -1 WHEN hits = 1 AND doc_id % 3 = 2 THEN 1 ELSE 0 END)::BIGINT AS n_lines, (hits = 1 AND doc_id % 3 = 0)::BIGINT AS replaced, (hits = 1 AND doc_id % 3 = 2)::BIGINT AS added FROM n JOIN h USING (doc_id)) WHERE n_lines > 0""",
    "fixup_missing": f"WITH {LINES_SQL}, f AS (SELECT doc_id, content AS needle FROM lines WHERE line_no = 0) SELECT l.doc_id, count(*)::BIGINT AS hits FROM lines l JOIN f ON l.doc_id = f.doc_id AND l.content = f.needle GROUP BY l.doc_id HAVING count(*) <> 1",
    "fixup_sequence": f"""WITH {LINES_SQL}, f AS (SELECT doc_id, content AS c0 FROM lines WHERE line_no = 0), h AS (SELECT l.doc_id, f.c0, count(*) AS n_lines, count(*) FILTER (l.content = f.c0) AS hits FROM lines l JOIN f USING (doc_id) GROUP BY 1, 2)
      SELECT doc_id, (n_lines + (hits = 1)::INT)::BIGINT AS n_lines, CASE WHEN hits = 1 THEN 'KETTŐ' ELSE c0 END AS first_line, (hits = 1)::BIGINT AS added, CASE WHEN hits = 1 THEN 0 ELSE 4 END::BIGINT AS failed FROM h""",
    "fixup_context": f"""WITH {LINES_SQL}, ch AS (SELECT doc_id, line_no, content FROM lines WHERE line_no % 5 = 4), x AS (SELECT doc_id, line_no, content, array_agg(content) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS a FROM lines),
      v AS (SELECT * FROM x SEMI JOIN ch USING (doc_id, content)), e AS (SELECT doc_id, line_no, content, k, CASE WHEN k = 0 THEN []::VARCHAR[] ELSE a[len(a) - k + 1:] END AS c FROM (SELECT *, unnest(range(0, coalesce(len(a), 0) + 1)) AS k FROM v)),
      u AS (SELECT doc_id, content, c, min(k) AS k, min(line_no) AS line_no FROM e GROUP BY doc_id, content, c HAVING count(*) = 1), m AS (SELECT doc_id, line_no, min(k) AS k FROM u GROUP BY 1, 2)
      SELECT doc_id, coalesce(k, -1)::BIGINT AS context, count(*)::BIGINT AS n FROM ch LEFT JOIN m USING (doc_id, line_no) GROUP BY 1, 2""",
    "issue_scan": """WITH o AS (SELECT DISTINCT year(o_orderdate)::BIGINT AS year, (o_custkey % 400 + 1)::BIGINT AS issue FROM orders), k AS (SELECT * FROM o WHERE (issue + year) % 97 <> 0),
      m AS (SELECT year, issue, row_number() OVER (PARTITION BY year ORDER BY issue) AS n FROM k) SELECT year, issue FROM m WHERE issue = n""",
}
