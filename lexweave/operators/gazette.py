"""Gazette issues to acts: sections carried over pages, acts cut out of the section of laws."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.dates import hungarian_date
from lexweave.operators.groups import map_groups

#: The headings of a gazette's sections; acts stand in the second.
SECTIONS = ("Tartalomjegyzék", "II. Törvények", "III. Kormányrendeletek", "IV. A Magyar Nemzeti Bank elnökének rendeletei,", "V. A Kormány tagjainak rendeletei", "VI.Az Alkotmánybíróság határozatai, teljes ülési", "VII. A Kúria határozatai", "IX. Határozatok Tára")
LAWS = SECTIONS[1]
#: How acts begin (a year of the last centuries, its number in Roman numerals) and how their signatures end.
ACT_HEADER = r"^(?:19|2[0-9])\d{2}\. évi [IVXLC]+\. törvény"
ACT_FOOTER = r"^köztársasági elnök\s+az Országgyűlés (?:elnöke|alelnöke)"
TITLE_WORDS = "MAGYAR KÖZLÖNY"
_HEADER, _FOOTER = re.compile(ACT_HEADER), re.compile(ACT_FOOTER)


def gazettes(lines: DataFrame) -> DataFrame:
    """issue_id and publication_date of the issues that are gazettes: their first line has the title, the fourth the date."""
    head = lines.where("page_no = 1 AND line_no IN (0, 3)").groupBy("issue_id").agg(F.max(F.when(F.col("line_no") == 0, F.col("content"))).alias("first"), F.max(F.when(F.col("line_no") == 3, F.col("content"))).alias("date"))
    return head.where(F.col("first").contains(TITLE_WORDS)).select("issue_id", hungarian_date(F.col("date")).alias("publication_date"))


def strip_headers(lines: DataFrame) -> DataFrame:
    """The lines without page headers: five on the first page, two on the others."""
    return lines.where(F.col("line_no") >= F.when(F.col("page_no") == 1, 5).otherwise(2))


def section_lines(lines: DataFrame) -> DataFrame:
    """issue_id, section, section_no, page_no, line_no, content, …: a page whose first line is a section's heading begins that section,
    others continue the one before. The heading itself is left out; an empty line ends every page; pages before any section are dropped.

    Only one row per page runs over the issue, so the window is short.
    """
    first = Window.partitionBy("issue_id", "page_no").orderBy("line_no")
    pages = lines.withColumn("top", F.row_number().over(first) == 1)
    heads = pages.where("top").select("issue_id", "page_no", F.when(F.col("content").isin(*SECTIONS), F.col("content")).alias("heading"))
    over = Window.partitionBy("issue_id").orderBy("page_no")
    named = heads.withColumn("section", F.last("heading", ignorenulls=True).over(over)).withColumn("changed", F.coalesce(F.col("section") != F.lag("section").over(over), F.lit(True)).cast("int"))
    numbered = named.withColumn("section_no", F.sum("changed").over(over)).where("section IS NOT NULL")
    body = pages.join(numbered.select("issue_id", "page_no", "section", "section_no", "heading"), ["issue_id", "page_no"]).where("NOT (top AND heading IS NOT NULL)")
    columns = ["issue_id", "section", "section_no", "page_no", "line_no", "content"]
    ends = numbered.select("issue_id", "section", "section_no", "page_no", F.lit(2**30).alias("line_no"), F.lit("").alias("content"))
    return body.select(*columns).unionByName(ends)


def _cut_acts(rows: list[dict]) -> Iterator[dict]:
    """The body lines of the acts in one section; a blank line, then a header, then the subject up to an asterisk, then the body up to the
    signatures."""
    content = [r["content"] for r in rows]
    n, i = len(content), 0
    while i < n:
        while i < n and content[i]:
            i += 1
        i += 1
        if i >= n or not _HEADER.match(content[i]):
            continue
        act, subject, i = content[i], [], i + 1
        while i < n and not (subject and subject[-1].endswith("*")):
            subject.append(content[i])
            i += 1
        start = i
        while i < n and not (i - start >= 3 and not content[i - 2] and _FOOTER.match(content[i])):
            i += 1
        body = content[start : i - 2 if i < n else n]
        note = next((k for k in range(1, len(body) - 1) if body[k].startswith("*") and not body[k - 1] and not body[k + 1]), None)
        if note is not None and note >= 2:
            body = body[: note - 1] + [""] + body[note + 2 :]
        told = {"issue_id": rows[0]["issue_id"], "act_id": act, "subject": " ".join(subject).rstrip("*"), "complete": i < n}
        yield from (told | {"line_no": k, "content": c} for k, c in enumerate(body))
        i += 1


def act_lines(sections: DataFrame, issues: DataFrame) -> DataFrame:
    """act_id, subject, publication_date, complete, line_no (from 0), content: the body lines of the acts in the sections of laws.

    A section is one run of pages of one issue; sections stream through their tasks sorted, one at a time in memory. An act without
    signatures at the end of its section comes out with complete = false instead of being lost. The note that a body's asterisk refers
    to is left out.
    """
    laws = sections.where(F.col("section") == LAWS).select("issue_id", "section_no", "page_no", "line_no", "content")
    arrow = pa.schema([("issue_id", pa.string()), ("act_id", pa.string()), ("subject", pa.string()), ("complete", pa.bool_()), ("line_no", pa.int32()), ("content", pa.string())])
    keyed = laws.withColumn("issue_id", F.col("issue_id").cast("string"))
    cut = map_groups(keyed, ["issue_id", "section_no"], ["page_no", "line_no"], _cut_acts, "issue_id string, act_id string, subject string, complete boolean, line_no int, content string", arrow)
    return cut.join(issues.withColumn("issue_id", F.col("issue_id").cast("string")), "issue_id").select("issue_id", "act_id", "subject", "publication_date", "complete", "line_no", "content")
