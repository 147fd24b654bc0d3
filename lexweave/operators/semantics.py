"""The semantic pass over elements: sentences in context, citations cut to their element, abbreviations resolved as of their place."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators import sentences as S
from lexweave.operators.elements import with_context
from lexweave.session import cut_lineage

KEYS = ("act_id", "element_id", "path")


class Semantics(NamedTuple):
    """citations, abbreviations and the long table of records of all elements."""

    citations: DataFrame
    abbreviations: DataFrame
    records: DataFrame


def resolved(found: DataFrame) -> DataFrame:
    """found with the act of every row that names one by an abbreviation defined at or before its place in the document.

    Every sentence holds its ancestors' intros, so a definition there is made again at each child; the last one before a use holds.
    Positions of enforcement dates are left as they are.
    """
    columns = found.columns
    named = (F.col("what") != "Abbreviation") & (F.col("what") != "EnforcementDate") & F.col("act").isNotNull()
    uses = found.where(named).withColumn("_short", F.col("act"))
    rest = found.where(~F.coalesce(named, F.lit(False)))
    definitions = found.where("what = 'Abbreviation'").select("act_id", "abbreviation", F.col("path").alias("_at"), "act")
    asked = uses.select("act_id", F.col("_short").alias("abbreviation"), F.col("path").alias("_at"), F.struct(*columns).alias("_row"))
    known = S.resolve_abbreviations(asked, definitions, "_at")
    put = known.select(*(F.coalesce("target_act", F.col("_row.act")).alias(c) if c == "act" else F.col(f"_row.`{c}`").alias(c) for c in columns))
    return put.unionByName(rest)


def analyze_elements(elements: DataFrame) -> Semantics:
    """Semantics of elements (act_id, element_id, parent_id, path, text, intro, wrap_up, in_amendment).

    Elements inside amendments belong to other acts and are not analysed. A citation counts for the element in whose own wording it
    ends; what lies before is cut off its front. Records are those of the whole sentence.
    """
    own = elements.where(~F.coalesce(F.col("in_amendment"), F.lit(False)) & (F.col("text").isNotNull() | F.col("intro").isNotNull()))
    sentences = with_context(own).withColumn("_skip", F.length("prefix")).withColumn("_most", F.length("sentence") - F.length("postfix"))
    found = cut_lineage(resolved(cut_lineage(S.analyze_sentences(sentences, [*KEYS, "_skip", "_most"], "sentence"))))
    keys = [*KEYS, "_skip", "_most"]
    cited = S.citations(found, keys).where("end_pos > _skip AND end_pos <= _most")
    cut = cited.withColumn("start_pos", F.greatest(F.lit(0), F.col("start_pos") - F.col("_skip"))).withColumn("end_pos", F.col("end_pos") - F.col("_skip"))
    return Semantics(cut.drop("_skip", "_most"), S.abbreviations(found, list(KEYS)), found.where("what NOT IN ('Citation', 'Abbreviation')").drop("_skip", "_most"))


def to_analyze(elements: DataFrame, done: DataFrame, new_abbreviations: DataFrame | None = None) -> DataFrame:
    """Elements that an incremental pass has to look at: not done yet, or of an act that has a new abbreviation.

    done: act_id, element_id. new_abbreviations: act_id.
    """
    fresh = elements.join(done.select("act_id", "element_id").distinct(), ["act_id", "element_id"], "left_anti")
    if new_abbreviations is None:
        return fresh
    again = elements.join(new_abbreviations.select("act_id").distinct(), "act_id", "left_semi").join(done.select("act_id", "element_id").distinct(), ["act_id", "element_id"], "left_semi")
    return fresh.unionByName(again)


def children_types(elements: DataFrame) -> DataFrame:
    """act_id, element_id, n_children and the one kind of its children; null kind if they are of several."""
    by = elements.where("parent_id IS NOT NULL").groupBy("act_id", F.col("parent_id").alias("element_id")).agg(F.count("*").alias("n_children"), F.min("kind").alias("a"), F.max("kind").alias("b"))
    return by.select("act_id", "element_id", "n_children", F.when(F.col("a") == F.col("b"), F.col("a")).alias("children_kind"))
