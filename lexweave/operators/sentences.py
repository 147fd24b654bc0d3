"""What sentences cite, abbreviate, amend, repeal and enforce, as rows.

The kernel runs once per sentence in an Arrow map; a native filter keeps uninteresting ones away from Python. Its results come as one
long table from which the tables of citations, abbreviations and records are plain filters and projections.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.kernels.citations import MAX_SENTENCE, NEEDLES, Analysis, Ref, analyze
from lexweave.operators.groups import spread

REF_COLUMNS = ("act", *(f"{x}_{e}" for x in ("article", "paragraph", "point", "subpoint") for e in ("first", "last")))
STRUCTURAL = ("book", "part", "title", "chapter", "subtitle", "special_position", "special_article")
_STRINGS, _INTS = pa.string(), pa.int32()
_FIELDS: tuple[tuple[str, pa.DataType, str], ...] = (
    ("what", _STRINGS, "string"), ("seq", _INTS, "int"), ("start_pos", _INTS, "int"), ("end_pos", _INTS, "int"),
    *((c, _STRINGS, "string") for c in REF_COLUMNS), *((c, _STRINGS, "string") for c in STRUCTURAL),
    ("abbreviation", _STRINGS, "string"), ("pure_insertion", pa.bool_(), "boolean"), ("date_kind", _STRINGS, "string"), ("exact_date", pa.date32(), "date"),
    ("days", _INTS, "int"), ("day", _INTS, "int"), ("months", _INTS, "int"), ("repeal_date", pa.date32(), "date"), ("original_text", _STRINGS, "string"), ("replacement_text", _STRINGS, "string"),
)


def _ref(r: Ref | None) -> dict:
    if r is None:
        return {}
    out = {"act": r.act}
    for name, value in zip(("article", "paragraph", "point", "subpoint"), r[1:], strict=True):
        if value:
            out[f"{name}_first"], out[f"{name}_last"] = value
    return out


def _date(d: tuple[int, int, int] | None) -> datetime.date | None:
    try:
        return datetime.date(*d) if d else None
    except ValueError:
        return None


def _rows(a: Analysis) -> Iterator[dict]:
    for i, c in enumerate(a.citations):
        yield {"what": "Citation", "seq": i, "start_pos": c.start, "end_pos": c.end} | _ref(c.ref)
    for i, b in enumerate(a.abbreviations):
        yield {"what": "Abbreviation", "seq": i, "abbreviation": b.abbreviation, "act": b.act}
    for i, r in enumerate(a.records):
        s = r.structural
        where = {"act": s.act, "book": s.book, "part": s.part, "title": s.title, "chapter": s.chapter, "subtitle": s.subtitle, "special_position": s.position, "special_article": s.article} if s else _ref(r.ref)
        yield {"what": r.kind, "seq": i, "pure_insertion": r.pure_insertion, "date_kind": r.date_kind, "exact_date": _date(r.date), "days": r.days, "day": r.day, "months": r.months, "repeal_date": _date(r.repeal_date), "original_text": r.original, "replacement_text": r.replacement} | where


def interesting(text: Column) -> Column:
    """Worth analysing: holds one of the needles and isn't too long."""
    return F.coalesce((F.length(text) <= MAX_SENTENCE) & text.rlike("|".join(n.replace(")", r"\)") for n in NEEDLES)), F.lit(False))


def analyze_sentences(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys and every citation, abbreviation and record of the sentences, one row each, told apart by `what`.

    Defined cases: null, empty, uninteresting and over-long texts have no row; a date that isn't in the calendar is null; repeated rows
    are analysed each; columns other than keys and text are not read.
    """
    plain = spread(df.where(interesting(F.col(text))).select(*keys, F.col(text).alias("_text")), *keys)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in plain.dtypes[:-1]), *(f"{c} {t}" for c, _, t in _FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, found = [], []
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                for row in _rows(analyze(t)):
                    source.append(i)
                    found.append(row)
            at = pa.array(source, pa.int32())
            yield pa.record_batch([*(batch.column(k).take(at) for k in range(len(keys))), *(pa.array([r.get(c) for r in found], t) for c, t, _ in _FIELDS)], names=[*keys, *(c for c, _, _ in _FIELDS)])

    return plain.mapInArrow(run, schema)


def citations(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return found.where("what = 'Citation'").select(*keys, "seq", "start_pos", "end_pos", *REF_COLUMNS)


def abbreviations(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return found.where("what = 'Abbreviation'").select(*keys, "seq", "abbreviation", "act")


def records(found: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """BlockAmendment, EnforcementDate, TextAmendment, ArticleTitleAmendment or Repeal rows with the columns of their kind."""
    own = {
        "BlockAmendment": (*STRUCTURAL, "pure_insertion"), "EnforcementDate": ("date_kind", "exact_date", "days", "day", "months", "repeal_date"),
        "TextAmendment": ("original_text", "replacement_text"), "ArticleTitleAmendment": ("original_text", "replacement_text"), "Repeal": (*STRUCTURAL, F.col("original_text").alias("text")),
    }[kind]
    return found.where(F.col("what") == kind).select(*keys, "seq", *REF_COLUMNS, *own)


#: An act's number in running text, for native extraction.
ACT_NUMBER = r"([0-9]+\. ?évi [IVXLCDM]+\. ?törvény)"


def act_mentions(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, pos, act: the acts that a text names by number, found without Python."""
    return df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(ACT_NUMBER), F.lit(1))).alias("pos", "act"))


def resolve_abbreviations(uses: DataFrame, definitions: DataFrame, order: str) -> DataFrame:
    """Adds target_act to uses (act_id, abbreviation, order): the act that the last definition at or before a use gave the abbreviation.

    Definitions and uses are one stream per (act_id, abbreviation), so an abbreviation of a large act is a group of its own. A definition
    holds for its own sentence; of several in one sentence the last counts. Abbreviations never defined before stay null.
    """
    d = definitions.select("act_id", "abbreviation", F.col(order).alias("_order"), F.lit(0).alias("_use"), F.col("act").alias("_act"))
    columns = [c for c in uses.columns]
    u = uses.select("act_id", "abbreviation", F.col(order).alias("_order"), F.lit(1).alias("_use"), F.lit(None).cast("string").alias("_act"), F.struct(*columns).alias("_row"))
    both = d.withColumn("_row", F.lit(None).cast(u.schema["_row"].dataType)).unionByName(u)
    w = Window.partitionBy("act_id", "abbreviation").orderBy("_order", "_use").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("target_act", F.last("_act", ignorenulls=True).over(w)).where("_use = 1").select("_row.*", "target_act")
