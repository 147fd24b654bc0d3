"""Queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import chunking, lookalike, mojibake, packing, spam, spans, tokens
from lexweave.session import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows whose bodies only look the same."""
    return lookalike.equal_looking_pairs(read(spark, sf_dir, "dashes"))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body in its consistent form."""
    return lookalike.consistent_bodies(read(spark, sf_dir, "dashes"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of equal-looking bodies, a row for each of their rows."""
    return lookalike.equal_looking_classes(read(spark, sf_dir, "dashes")).select("row_id", "n_rows", "n_spellings")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared spans of every element."""
    return spans.shared_spans(read(spark, sf_dir, "btk_mod_1")).drop("body_chars")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each element is shared."""
    return spans.shared_shares(read(spark, sf_dir, "btk_mod_1"))


def p3_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a stretch each element shares, by doubling."""
    return spans.longest_shared(read(spark, sf_dir, "btk_mod_1"))


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every garbled field with its wording restored as far as it can be."""
    fields = mojibake.fields_of(read(spark, sf_dir, "subpoints"))
    return mojibake.restore_fields(fields, mojibake.fit(fields, texts=read(spark, sf_dir, "documents").select("lang", "text")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled fields."""
    return p4_restored(spark, sf_dir).select("row_id", "field_name")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized item."""
    return chunking.split_items(read(spark, sf_dir, "numeric_subpoints"), read(spark, sf_dir, "chunk_limits"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that had to be cut; an oversized item has one first piece."""
    return p5_pieces(spark, sf_dir).where("piece_no = 1 AND n_pieces > 1").select("row_id")


def p5_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized item put together again from its pieces, and whether these keep to the limit and the overlap of its kind."""
    items, limits = read(spark, sf_dir, "numeric_subpoints"), read(spark, sf_dir, "chunk_limits")
    pieces = chunking.split_items(items, limits).join(items.select("row_id", "kind"), "row_id").join(limits, "kind")
    own = F.struct("piece_no", F.expr("substring(piece, cast(overlap + 1 as int))").alias("new"))
    by = pieces.groupBy("row_id").agg(F.array_sort(F.collect_list(own)).alias("parts"), F.max(F.length("piece") - F.col("max_chars")).alias("over"), F.max(F.col("overlap") - F.col("overlap_chars")).alias("more"))
    return by.select("row_id", F.md5(F.array_join(F.transform("parts", lambda p: p["new"]), "")).alias("item_md5"), (F.col("over") <= 0).alias("within"), (F.col("more") <= 0).alias("overlaps"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(read(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of 2,048 tokens with their pieces."""
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    by = p7_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    room = packing.Limits().tokens
    return by.agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"), F.ceil(F.sum("used") / room).alias("least_containers"), F.max("used").alias("fullest"))


def p7_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of instruction data, where segments and loss-bearing tokens bind beside tokens."""
    return packing.pack_instructions(read(spark, sf_dir, "documents"))


def p7_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that needs a place, and whether its pieces are whole, in order and no more than they must be."""
    by = p7_containers(spark, sf_dir).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("last"), F.count("*").alias("pieces"))
    return by.select("doc_id", (F.col("n") == F.col("last")).alias("whole"), (F.col("pieces") == F.ceil(F.col("n") / packing.Limits().tokens)).alias("fewest"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-stuffed and link-list pages."""
    return spam.spam_pages(read(spark, sf_dir, "documents"))


def p8_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence for every document."""
    return spam.profiles(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_forms, p1_classes, p3_found, p3_shares, p3_longest, p4_found, p4_restored, p5_found, p5_pieces, p5_rejoined, p6_ids, p7_containers, p7_fill, p7_instructions, p7_placed, p8_found, p8_profiles)}
#: Fixed values for p1_found's SQL: what the characters of `dashes` look like.
_ALIKE = ("АВСЕНІЈКМОРЅТХУаеорсухѕіјһӧΑΒΕΖΗΙΚΜΝΟΡΤΥΧονίόι", "ABCEHIJKMOPSTXYaeopcyxsijhöABEZHIKMNOPTYXovíói")
_SPELLED = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬅ", "ſt"), ("ﬆ", "st"), ("ǉ", "lj"), ("ǈ", "Lj"), ("ǌ", "nj"), ("ǋ", "Nj"), ("Ⅰ", "I"), ("Ⅱ", "II"), ("Ⅲ", "III"), ("Ⅳ", "IV"), ("Ⅴ", "V"), ("Ⅵ", "VI"), ("Ⅶ", "VII"), ("Ⅷ", "VIII"), ("Ⅸ", "IX"), ("Ⅹ", "X"), ("Ⅺ", "XI"), ("Ⅻ", "XII"))
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))


def _form_sql(column: str) -> str:
    out = f"regexp_replace({column}, '[' || chr(173) || chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279) || ']', '', 'g')"
    for c, r in _SPELLED:
        out = f"replace({out}, '{c}', '{r}')"
    quote = lambda t: t.replace("'", "''")
    out = f"translate({out}, '{quote(_WIDE[0] + _ALIKE[0])}‐‑', '{quote(_WIDE[1] + _ALIKE[1])}--')"
    blanks = " || ".join(f"chr({c})" for c in (160, *range(8192, 8203), 8239, 8287, 12288, 9, 10, 13))
    return f"trim(regexp_replace(nfc_normalize({out}), '[ ' || {blanks} || ']+', ' ', 'g'), ' ')"


_SPANS = """WITH e AS (SELECT DISTINCT act_id, element_id, coalesce(text, intro) AS body FROM btk_mod_1 WHERE length(coalesce(text, intro)) >= 120),
      w AS (SELECT act_id, element_id, p, substring(body, p + 1, 120) AS s FROM (SELECT *, unnest(range(length(body) - 119)) AS p FROM e)),
      c AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT (act_id, element_id)) > 1), h AS (SELECT act_id, element_id, p FROM w SEMI JOIN c USING (s)),
      i AS (SELECT *, CASE WHEN p > lag(p) OVER o + 120 THEN 1 ELSE 0 END AS d FROM h WINDOW o AS (PARTITION BY act_id, element_id ORDER BY p)), g AS (SELECT *, sum(d) OVER (PARTITION BY act_id, element_id ORDER BY p) AS k FROM i)"""
_ITEMS = """WITH c AS (SELECT n.row_id, l.max_chars, n.text, n.intro, n.wrap_up, from_json(children, '[{"__type__":"VARCHAR","identifier":"VARCHAR","text":"VARCHAR"}]') AS kids FROM numeric_subpoints n JOIN chunk_limits l USING (kind)),
      t AS (SELECT row_id, max_chars, CASE WHEN text IS NOT NULL THEN text ELSE array_to_string(list_filter(list_concat([intro], list_transform(coalesce(kids, []), lambda x: x.identifier || CASE WHEN x."__type__" = 'NumericSubpoint' THEN '. ' ELSE ') ' END || x.text), [wrap_up]), lambda x: x IS NOT NULL), ' ') END AS item FROM c)"""
SQL = {
    "p1_found": f"""WITH b AS (SELECT row_id, coalesce(text, intro) AS body FROM dashes WHERE coalesce(text, intro) IS NOT NULL), f AS (SELECT row_id, body, {_form_sql("body")} AS form FROM b)
      SELECT x.row_id AS row_id_a, y.row_id AS row_id_b FROM f x JOIN f y ON x.form = y.form AND x.row_id < y.row_id AND x.body <> y.body""",
    "p1_classes": f"""WITH b AS (SELECT row_id, coalesce(text, intro) AS body FROM dashes WHERE coalesce(text, intro) IS NOT NULL), f AS (SELECT row_id, body, {_form_sql("body")} AS form FROM b),
      c AS (SELECT form, count(*) AS n_rows, count(DISTINCT body) AS n_spellings FROM f GROUP BY 1 HAVING count(DISTINCT body) > 1) SELECT row_id, n_rows, n_spellings FROM f JOIN c USING (form)""",
    "p3_found": f"""{_SPANS}
      SELECT act_id, element_id, min(p)::BIGINT AS start_pos, (max(p) + 120)::BIGINT AS end_pos FROM g GROUP BY act_id, element_id, k""",
    "p3_shares": f"""{_SPANS}, z AS (SELECT act_id, element_id, max(p) + 120 - min(p) AS chars FROM g GROUP BY act_id, element_id, k), y AS (SELECT act_id, element_id, sum(chars)::BIGINT AS shared_chars FROM z GROUP BY 1, 2)
      SELECT y.*, length(body) AS body_chars, shared_chars / length(body) AS share FROM y JOIN e USING (act_id, element_id)""",
    "p5_found": f"""{_ITEMS}
      SELECT row_id FROM t WHERE length(item) > max_chars""",
    "p5_rejoined": f"""{_ITEMS}
      SELECT row_id, md5(item) AS item_md5, true AS within, true AS overlaps FROM t WHERE length(item) > max_chars""",
    "p7_placed": "SELECT doc_id, true AS whole, true AS fewest FROM documents WHERE length(text) > 0",
}
