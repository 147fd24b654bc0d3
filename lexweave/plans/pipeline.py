"""From the lines of gazettes to acts, up to the step that is asked for.

`run` goes as far as the step asked for and gives the tables of that step; `write` writes acts in a format. Where it is known which issue
an act stands in, a single act is pushed down to that issue's lines; else it is picked before anything is parsed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators import elements as E
from lexweave.operators import fixups as X
from lexweave.operators import gazette as G
from lexweave.operators.scans import BLOCK_ROWS, running_sum
from lexweave.operators.semantics import Semantics, analyze_elements
from lexweave.session import cut_lineage
from lexweave.sinks import files, render
from lexweave.sources.lines import text_lines

STEPS = ("raw_act", "structure_only", "ba_only", "full")
#: More lines than patches add after any one.
MOST_ADDED = 4_096
FORMATS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {"txt": (render.txt, "txt"), "html": (render.html, "html"), "json": (render.nested_json, "json")}


def raw_acts(lines: DataFrame, single_act: str | None = None) -> DataFrame:
    """act_id, subject, publication_date, complete, line_no, content of the acts in gazettes. lines: issue_id, page_no, line_no, content."""
    cut = G.act_lines(G.section_lines(G.strip_headers(lines)), G.gazettes(lines))
    return cut if single_act is None else cut.where(F.col("act_id") == single_act)


def structure(act_lines: DataFrame, fixups: DataFrame | None = None) -> DataFrame:
    """Elements of acts from their lines, patched first. Lines may bring indent, margin_right, bold and gaps; without an
    indent it is told by the blanks that lines begin with, as in plain text."""
    lines = act_lines
    if fixups is not None:
        patched = X.apply_fixups(lines.select("act_id", "line_no", "content"), fixups)
        shape = [c for c in ("indent", "margin_right", "bold", "gaps") if c in lines.columns]
        kept = lines.select("act_id", "line_no", *shape)
        # Added lines move the following ones down; lines of an act get dense numbers again by counting those before.
        wide = patched.join(kept, ["act_id", "line_no"], "left").withColumn("_place", F.col("line_no").cast("bigint") * MOST_ADDED + F.col("sub_no"))
        lines = running_sum(wide, ["act_id"], "_place", F.lit(1), "_n", inclusive=False, block_rows=BLOCK_ROWS * MOST_ADDED).withColumn("line_no", F.col("_n").cast("int")).drop("_n", "_place", "sub_no")
    if "indent" not in lines.columns:
        told = text_lines(lines.select(F.struct("act_id", "line_no").alias("k"), "content"), "k", "content")
        lines = told.select("doc_id.act_id", "doc_id.line_no", "content", "indent", "margin_right", "bold", "gaps")
    defaults = {"indent": F.lit(0.0), "margin_right": F.lit(0.0), "bold": F.lit(False), "gaps": F.array().cast("array<struct<at:int,width:double>>")}
    full = lines.withColumns({c: F.coalesce(F.col(c), v) if c in lines.columns else v for c, v in defaults.items()})
    return E.parse_acts(full.select("act_id", "line_no", "content", *defaults, (F.col("content") == "").alias("is_empty")))


def open_blocks(elements: DataFrame) -> DataFrame:
    """Elements with the quoted blocks of amending paragraphs replaced by what they hold; blocks that can't be opened stay."""
    once = cut_lineage(elements)
    opened = E.open_amendments(once)
    done = opened.where("kind = 'BlockAmendmentContainer' AND error IS NULL").select("act_id", "parent_id").distinct()
    stays = once.join(done.withColumn("kind", F.lit("QuotedBlock")), ["act_id", "parent_id", "kind"], "left_anti")
    return stays.unionByName(opened)


class Result(NamedTuple):
    """What a run has made: act lines with their header columns, elements from the second step on, semantics of the last."""

    acts: DataFrame
    elements: DataFrame | None = None
    semantics: Semantics | None = None


def run(lines: DataFrame, step: str = STEPS[-1], single_act: str | None = None, issue_of: DataFrame | None = None, fixups: DataFrame | None = None, modifiers: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> Result:
    """The lines of gazettes up to one of STEPS. issue_of: act_id, issue_id. modifiers rewrite the elements in turn, once they are parsed.

    Defined cases: an act that isn't there gives empty tables, as do empty lines; patches of other acts are left out.
    """
    if step not in STEPS:
        raise ValueError(f"{step} is none of {', '.join(STEPS)}")
    if single_act is not None and issue_of is not None:
        lines = lines.join(issue_of.where(F.col("act_id") == single_act).select("issue_id").distinct(), "issue_id", "left_semi")
    acts = raw_acts(lines, single_act)
    if step == "raw_act":
        return Result(acts)
    # The caller reads the acts' headers and their elements as well as what is made of them.
    acts = cut_lineage(acts)
    if fixups is not None and single_act is not None:
        fixups = fixups.where(F.col("act_id") == single_act)
    elements = structure(acts.select("act_id", "line_no", "content"), fixups)
    for change in modifiers:
        elements = change(elements)
    if step == "structure_only":
        return Result(acts, elements)
    opened = cut_lineage(open_blocks(elements))
    return Result(acts, opened, None if step == "ba_only" else analyze_elements(opened))


def write(elements: DataFrame, fmt: str, folder: str, semantics: Semantics | None = None, acts_per_file: bool = True) -> None:
    """Acts as files of a format, one folder per act or many acts a file; JSON has what the semantic pass found, if that is given."""
    make, column = FORMATS[fmt]
    documents = render.nested_json(elements, semantics=semantics) if fmt == "json" else make(elements)
    files.write_acts(documents, column, folder, acts_per_file=acts_per_file)
