"""Lines of text from plain text, positioned characters and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import fix_glyphs, quote_change

#: Points of a character of plain text, and right margins of justified and ragged lines.
CHAR_WIDTH, JUSTIFIED, RAGGED = 5.0, 5.0, 40.0
#: Markers in plain text: bold and not justified lines; they stand for as many spaces as they have characters.
BOLD_MARK, RAGGED_MARK = "<BOLD>", "<NJ>"
#: Glyphs whose baselines differ by less are one line; lines further apart have an empty line between them.
SAME_LINE, EMPTY_GAP = 0.2, 18.0
#: Fixed value: characters that the gazettes' fonts use privately or that format; a glyph beginning with one is dropped, as are blanks.
DROPPED_GLYPH = r"^[\p{Co}\p{Cf} ]"


def _gaps(stripped: Column) -> Column:
    """(at, width) of every place where more than one blank stood."""
    kind = "struct<pos:int,more:int,gaps:array<struct<at:int,width:double>>>"
    zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("more"), F.array().cast("array<struct<at:int,width:double>>").alias("gaps")).cast(kind)
    gap = lambda a: F.array(F.struct(a["pos"].alias("at"), (a["more"] * CHAR_WIDTH).cast("double").alias("width")))
    step = lambda a, w: F.when(w == "", F.struct(a["pos"].alias("pos"), (a["more"] + 1).alias("more"), a["gaps"].alias("gaps"))).otherwise(F.struct((a["pos"] + F.length(w) + 1).cast("int").alias("pos"), F.lit(0).alias("more"), F.when(a["more"] > 0, F.concat(a["gaps"], gap(a))).otherwise(a["gaps"]).alias("gaps")))
    return F.aggregate(F.split(stripped, " "), zero, lambda a, w: step(a, w).cast(kind))["gaps"]


def text_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, line_no (from 0), content, indent, margin_right, bold, is_empty, gaps: one row per line of each text.

    Each leading space indents by CHAR_WIDTH, blanks run together in content and leave a gap. Defined cases: a null text has no line, an
    empty one a single empty line; carriage returns belong to the line end; tabs count as spaces.
    """
    split = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.regexp_replace(F.col(text), "\r", ""), "\n")).alias("line_no", "raw"))
    marked = split.withColumn("bold", F.col("raw").contains(BOLD_MARK)).withColumn("ragged", F.col("raw").contains(RAGGED_MARK))
    spaces = F.regexp_replace(F.replace(F.replace(F.col("raw"), F.lit(BOLD_MARK), F.lit(" " * len(BOLD_MARK))), F.lit(RAGGED_MARK), F.lit(" " * len(RAGGED_MARK))), "\t", " ")
    plain = marked.withColumn("raw", spaces).withColumn("stripped", F.trim("raw"))
    content = F.regexp_replace("stripped", " +", " ")
    empty = F.col("stripped") == ""
    return plain.select(
        "doc_id", "line_no", content.alias("content"),
        F.when(empty, F.lit(0.0)).otherwise(CHAR_WIDTH * (F.length("raw") - F.length(F.ltrim("raw")) + 2)).cast("double").alias("indent"),
        F.when(empty, F.lit(0.0)).when(F.col("ragged"), F.lit(RAGGED)).otherwise(F.lit(JUSTIFIED)).alias("margin_right"),
        (F.col("bold") & ~empty).alias("bold"), empty.alias("is_empty"), _gaps(F.col("stripped")).alias("gaps"),
    )


def glyph_lines(boxes: DataFrame) -> DataFrame:
    """issue_id, page_no, line_no, content, indent, margin_right, bold, is_empty from positioned characters.

    boxes: issue_id, page_no, x, y, width, width_of_space, content, bold. Characters whose y differ by less than SAME_LINE from the one
    before are a line, from the top down; a space stands where the next character begins beyond the last one's end and half a space, or
    opens a quote; an empty line where lines are further apart than EMPTY_GAP. Everything happens within a page, so a page is the unit.

    Defined cases: a character drawn twice at a place counts once; blanks and private characters are dropped; pages without characters
    have no line; null positions are dropped.
    """
    page = ["issue_id", "page_no"]
    shown = boxes.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("content").isNotNull() & ~F.col("content").rlike(DROPPED_GLYPH) & (F.col("content") != ""))
    once = shown.groupBy(*page, "y", "x").agg(*(F.first(c).alias(c) for c in ("width", "width_of_space", "bold")), F.min("content").alias("content"))
    up = Window.partitionBy(*page).orderBy("y", "x")
    breaks = once.withColumn("new", F.coalesce((F.col("y") - F.lag("y").over(up) >= SAME_LINE).cast("int"), F.lit(0)))
    bands = breaks.withColumn("band", F.sum("new").over(up)).withColumn("right", F.max(F.col("x") + F.col("width")).over(Window.partitionBy(*page)))
    across = Window.partitionBy(*page, "band").orderBy("x")
    end = F.lag(F.col("x") + F.col("width") + F.col("width_of_space") * 0.5).over(across)
    spaced = bands.withColumn("glyph", F.concat(F.when((F.col("x") > end) | ((F.col("content") == "„") & end.isNotNull()), F.lit(" ")).otherwise(F.lit("")), fix_glyphs(F.col("content"))))
    parts = F.array_sort(F.collect_list(F.struct("x", "glyph", "bold", "width")))
    line = spaced.groupBy(*page, "band").agg(parts.alias("parts"), F.min("y").alias("y"), F.first("right").alias("right"))
    chars = lambda bold: F.aggregate("parts", F.lit(0), lambda a, p: a + F.when(p["bold"] | F.lit(not bold), F.length(p["glyph"])).otherwise(F.lit(0)))
    last = F.element_at("parts", -1)
    down = Window.partitionBy(*page).orderBy(F.desc("y"))
    lines = line.select(*page, "y", F.array_join(F.transform("parts", lambda p: p["glyph"]), "").alias("content"), F.col("parts")[0]["x"].alias("indent"), (F.col("right") - (last["x"] - last["width"])).alias("margin_right"), (chars(True) * 2 > chars(False)).alias("bold"))
    gap = lines.withColumn("gap", F.coalesce(F.lag("y").over(down) - F.col("y") > EMPTY_GAP, F.lit(False)))
    rows = gap.withColumn("is_empty", F.explode(F.when(F.col("gap"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    numbered = rows.withColumn("line_no", F.row_number().over(Window.partitionBy(*page).orderBy(F.desc("y"), F.desc("is_empty"))) - 1)
    blank = lambda c, empty: F.when(F.col("is_empty"), F.lit(empty)).otherwise(F.col(c)).alias(c)
    return numbered.select(*page, "line_no", blank("content", ""), blank("indent", 0.0), blank("margin_right", 0.0), blank("bold", False), "is_empty")


def html_texts(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """page_id, pos (from 0), tag, text: the texts of a page in order, each with the tag before it; entities of blanks resolved."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"<([^>]*)>([^<]*)"), F.lit(0))
    each = pages.select(F.col(page_id).alias("page_id"), F.posexplode(found).alias("pos", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"^<[^>]*>", ""), "&nbsp;| ", " "))
    return each.select("page_id", "pos", F.regexp_extract("raw", r"^</?([a-zA-Z0-9]*)", 1).alias("tag"), text.alias("text")).where("text <> ''")


def issue_index(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """page_id, act_id, title: the acts that an index page lists; the text after an act's number is its title."""
    w = Window.partitionBy("page_id").orderBy("pos")
    texts = html_texts(pages, page_id, html).withColumn("act_id", F.lag("text").over(w))
    return texts.where(F.col("act_id").rlike(r"^20..\. évi .* törvény$")).select("page_id", "act_id", F.col("text").alias("title"))


def issue_file(year: Column, issue: Column) -> Column:
    """The file of a gazette issue: two digits of the year, three of the number."""
    return F.format_string("MK%02d%03d.pdf", F.pmod(year.cast("int"), F.lit(100)), issue.cast("int"))


def with_quote_change(lines: DataFrame) -> DataFrame:
    return lines.withColumn("quote_change", quote_change(F.col("content")))


#: Tags of HTML that have no end.
_VOID = ("br", "img", "hr", "meta", "link", "input")


def html_stack(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """page_id, pos, stack, text: every text with the open tags it stands in; an end tag closes what was opened since its tag, and one
    without a beginning nothing. A page is one row, so the stack is folded within it."""
    tokens = F.regexp_extract_all(F.col(html), F.lit(r"(<[^>]*>|[^<]+)"), F.lit(1))
    kind = "struct<stack:array<string>,out:array<struct<stack:array<string>,text:string>>>"
    tag = lambda t: F.lower(F.regexp_extract(t, r"^</?([a-zA-Z0-9]+)", 1))

    def step(a: Column, t: Column) -> Column:
        depth = F.size(a["stack"]) - F.array_position(F.reverse(a["stack"]), tag(t)).cast("int")
        popped = F.when(F.array_contains(a["stack"], tag(t)), F.slice(a["stack"], F.lit(1), depth)).otherwise(a["stack"])
        opened = F.when(tag(t).isin(*_VOID) | t.endswith("/>") | (tag(t) == ""), a["stack"]).otherwise(F.concat(a["stack"], F.array(tag(t))))
        stack = F.when(t.startswith("</"), popped).when(t.startswith("<"), opened).otherwise(a["stack"])
        text = F.trim(F.regexp_replace(t, "&nbsp;|\u00a0|\\s", " "))
        out = F.when(t.startswith("<") | (text == ""), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["stack"].alias("stack"), text.alias("text")))))
        return F.struct(stack.alias("stack"), out.alias("out")).cast(kind)

    zero = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<stack:array<string>,text:string>>").alias("out")).cast(kind)
    each = pages.select(F.col(page_id).alias("page_id"), F.posexplode(F.aggregate(tokens, zero, step)["out"]).alias("pos", "t"))
    return each.select("page_id", "pos", "t.stack", "t.text")


def until_missing(found: DataFrame, group: str, number: str) -> DataFrame:
    """Of the numbers found in each group, those of the unbroken run from 1. Repeated numbers count once; nulls are none.

    A number belongs to the run if as many numbers up to it were found; only distinct numbers are ranked.
    """
    w = Window.partitionBy(group).orderBy(number)
    once = found.select(group, number).where(F.col(number).isNotNull()).distinct()
    return once.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == F.col(number)).drop("_rank")


def glyph_conflicts(boxes: DataFrame) -> DataFrame:
    """issue_id, page_no, y, x, contents of places where different characters are drawn on each other."""
    by = boxes.groupBy("issue_id", "page_no", "y", "x").agg(F.array_sort(F.collect_set("content")).alias("contents"))
    return by.where(F.size("contents") > 1)
