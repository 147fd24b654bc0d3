"""Acts as JSON, plain text and HTML.

Each element becomes a fragment by a Column expression of its kind; fragments are put in document order by their path, article by article,
and articles are joined to documents of at most PART_CHARS characters and one article. An act that is longer comes in several rows,
numbered by `part`, so nothing grows with an act. `pieces` are the fragments themselves, to be written in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.identifiers import header_prefix
from lexweave.functions.numerals import arabic_to_roman, ordinal_word
from lexweave.kernels.structure import SPECIAL_PARTS
from lexweave.operators.groups import map_groups
from lexweave.operators.scans import running_sum
from lexweave.operators.semantics import Semantics
from lexweave.session import cut_lineage


def formatted_heading(kind: Column, identifier: Column, special: Column) -> Column:
    """`ELSŐ KÖNYV`, `MÁSODIK RÉSZ`, `XII/A. CÍM`, `IV. FEJEZET`, `17.`; special parts by name."""
    n = identifier.try_cast("int")
    named = F.get(F.array(*map(F.lit, SPECIAL_PARTS)), n - 1)
    word, roman = F.upper(ordinal_word(n)), arabic_to_roman(identifier)
    return (
        F.when(kind == "Book", F.concat(word, F.lit(" KÖNYV")))
        .when(kind == "Part", F.when(F.coalesce(special, F.lit(False)), named).otherwise(F.concat(word, F.lit(" RÉSZ"))))
        .when(kind == "Title", F.concat(roman, F.lit(". CÍM")))
        .when(kind == "Chapter", F.concat(roman, F.lit(". FEJEZET")))
        .when(kind == "Subtitle", F.when(F.coalesce(identifier, F.lit("")) == "", F.lit("")).otherwise(F.concat(identifier, F.lit("."))))
    )


#: Characters of an act's document in one row; longer acts have further parts.
PART_CHARS = 32_000_000


def _pad(s: Column, width: int) -> Column:
    """At least `width` characters; longer ones stay whole."""
    return F.rpad(s, F.greatest(F.lit(width), F.length(s)), F.lit(" "))


def wrap(s: Column, width: Column | int) -> Column:
    """Lines of at most width characters, broken at blanks; a longer word stands alone."""
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))
    grown = lambda a, w: F.when(a["line"] == "", w).otherwise(F.concat(a["line"], F.lit(" "), w))

    def step(a: Column, w: Column) -> Column:
        fits = (a["line"] == "") | (F.length(a["line"]) + 1 + F.length(w) <= width)
        return F.struct(F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["line"]))).alias("done"), F.when(fits, grown(a, w)).otherwise(w).alias("line"))

    return F.aggregate(words, start, step, lambda a: F.concat(a["done"], F.when(a["line"] != "", F.array(a["line"])).otherwise(F.array().cast("array<string>"))))


def _hanging(indent: Column, head: Column, body: Column, width: int) -> Column:
    """Wrapped text behind a head; its further lines stand below its first."""
    room = F.greatest(F.lit(10), width - F.length(indent) - F.length(head))
    lines = wrap(body, room)
    lines = F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("")))
    return F.array_join(F.transform(lines, lambda x, i: F.rtrim(F.concat(indent, F.when(i == 0, head).otherwise(F.repeat(F.lit(" "), F.length(head))), x))), "\n")


def txt_pieces(elements: DataFrame, width: int = 90) -> DataFrame:
    """act_id, path, late, piece: what each element contributes to its act's plain text; in order of these columns they are the text."""
    kind, is_heading = F.col("kind"), F.col("kind").isin("Book", "Part", "Title", "Chapter", "Subtitle")
    head = F.when(is_heading, F.lit("")).when(kind == "Article", _pad(F.concat("identifier", F.lit(". §")), 10)).otherwise(_pad(header_prefix(kind, F.col("identifier")), 5))
    heading = formatted_heading(kind, F.col("identifier"), F.col("special"))
    body = F.when(is_heading, F.concat_ws(" ", F.when(heading != "", heading), F.col("title"))).when(kind == "Article", F.coalesce(F.concat(F.lit("["), "title", F.lit("]")), F.lit(""))).otherwise(F.coalesce("text", "intro", F.lit("")))
    indent = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.col("depth")) * 5)
    e = elements.withColumn("_indent", indent).withColumn("_head", head).withColumn("_body", body)
    quoted = F.array_join(F.concat(F.array(F.concat("_indent", F.lit("„"))), F.transform("quoted", lambda q: F.concat("_indent", F.lit("     "), q["content"])), F.array(F.concat("_indent", F.lit("”")))), "\n") if "quoted" in elements.columns else F.lit(None).cast("string")
    pieces = e.select("act_id", "path", F.coalesce(quoted, _hanging(F.col("_indent"), F.col("_head"), F.col("_body"), width)).alias("piece"), F.lit(0).alias("late"))
    # A wrap-up stands after all that is below its element: its path sorts behind theirs.
    after = e.where("wrap_up IS NOT NULL AND wrap_up <> ''").select("act_id", F.concat("path", F.array(F.lit(2**31 - 1))).alias("path"), _hanging(F.col("_indent"), F.repeat(F.lit(" "), F.length("_head")), F.col("wrap_up"), width).alias("piece"), F.lit(1).alias("late"))
    return pieces.unionByName(after)


def txt(elements: DataFrame, width: int = 90, part_chars: int = PART_CHARS) -> DataFrame:
    """act_id, part, txt: every act as plain text of at most width characters, elements indented by depth, words wrapped."""
    return _together(txt_pieces(elements, width), "\n", part_chars).select("act_id", "part", F.col("document").alias("txt"))


def _together(pieces: DataFrame, between: str, part_chars: int, ends: tuple[Column | str, Column | str] | None = None) -> DataFrame:
    """act_id, part, document of pieces; ends stand before the first part of an act and behind its last."""
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "late", "piece"))), lambda p: p["piece"]), between)
    articles = pieces.groupBy("act_id", F.col("path")[0].alias("top")).agg(one.alias("text"))
    return _parts(articles, between, part_chars, ends)


def _parts(articles: DataFrame, between: str, part_chars: int, ends: tuple[Column | str, Column | str] | None = None) -> DataFrame:
    """act_id, part, document of the texts of articles (act_id, top, text)."""
    # The articles are read for the sizes and for the texts.
    written = cut_lineage(articles)
    sized = running_sum(written.select("act_id", "top", F.length("text").alias("_size")), ["act_id"], "top", F.col("_size"), "_before", inclusive=False)
    part = sized.select("act_id", "top", F.floor(F.col("_before") / part_chars).cast("int").alias("part"))
    last = part.groupBy("act_id").agg(F.max("part").alias("_last"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "text"))), lambda x: x["text"]), between)
    documents = written.join(part, ["act_id", "top"]).groupBy("act_id", "part").agg(ordered.alias("document"))
    if ends is None:
        return documents
    nothing = F.lit("")
    before, after = ends
    with_last = documents.join(last, "act_id")
    return with_last.select("act_id", "part", F.concat(F.when(F.col("part") == 0, before).otherwise(nothing), "document", F.when(F.col("part") == F.col("_last"), after).otherwise(F.lit(between))).alias("document"))


def escape(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def with_links(text: Column, links: Column) -> Column:
    """Text with links (array of start_pos, end_pos, href, not overlapping) as anchors; overlapping ones after the first are left out."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        ok = (x["start_pos"] >= a["at"]) & (x["end_pos"] > x["start_pos"])
        before = F.substr(text, a["at"] + 1, x["start_pos"] - a["at"])
        inside = F.substr(text, x["start_pos"] + 1, x["end_pos"] - x["start_pos"])
        linked = F.concat(a["out"], escape(before), F.lit('<a href="'), x["href"], F.lit('">'), escape(inside), F.lit("</a>"))
        return F.struct(F.when(ok, linked).otherwise(a["out"]).alias("out"), F.when(ok, x["end_pos"]).otherwise(a["at"]).cast("int").alias("at"))

    return F.when(F.coalesce(F.size(links), F.lit(0)) <= 0, escape(text)).otherwise(F.aggregate(F.array_sort(links), start, step, lambda a: F.concat(a["out"], escape(F.substr(text, a["at"] + 1, F.length(text))))))


def html(elements: DataFrame, links: DataFrame | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """act_id, part, html: every act as an HTML document. links: act_id, element_id, start_pos, end_pos, href of places in text or intro.

    Elements have their id as anchor, but those in amendments, which belong to another act.
    """
    e = elements.withColumn("links", F.lit(None).cast("array<struct<start_pos:int,end_pos:int,href:string>>"))
    if links is not None:
        by = links.groupBy("act_id", "element_id").agg(F.collect_list(F.struct(F.col("start_pos").cast("int").alias("start_pos"), F.col("end_pos").cast("int").alias("end_pos"), "href")).alias("links"))
        e = elements.join(by, ["act_id", "element_id"], "left")
    css = F.lower("kind")
    anchor = F.when(F.coalesce(F.col("in_amendment"), F.lit(False)), F.lit("")).otherwise(F.col("element_id"))
    ident = F.concat(F.lit('<div id="'), anchor, F.lit('" class="'), css, F.lit('_id">'), escape(header_prefix(F.col("kind"), F.col("identifier"))), F.lit("</div>"))
    body = F.coalesce(F.col("text"), F.col("intro"))
    text = F.when(body.isNotNull(), F.concat(F.lit('<div class="'), css, F.lit('_text">'), with_links(body, F.col("links")), F.lit("</div>"))).otherwise(F.lit(""))
    heading = F.concat(F.lit('<div class="se_'), css, F.lit('">'), F.coalesce(formatted_heading(F.col("kind"), F.col("identifier"), F.col("special")), F.lit("")), F.lit("<br>"), escape(F.coalesce("title", F.lit(""))), F.lit("</div>"))
    title = F.when(F.col("title").isNotNull(), F.concat(F.lit('<div class="article_title">['), escape(F.col("title")), F.lit("]</div>"))).otherwise(F.lit(""))
    piece = F.when(F.col("kind").isin("Book", "Part", "Title", "Chapter", "Subtitle"), heading).when(F.col("kind") == "Article", F.concat(ident, title)).otherwise(F.concat(ident, text))
    pieces = e.select("act_id", "path", piece.alias("piece"), F.lit(0).alias("late"))
    after = e.where("wrap_up IS NOT NULL AND wrap_up <> ''").select("act_id", F.concat("path", F.array(F.lit(2**31 - 1))).alias("path"), F.concat(F.lit('<div class="'), css, F.lit('_text">'), escape(F.col("wrap_up")), F.lit("</div>")).alias("piece"), F.lit(1).alias("late"))
    head = F.concat(F.lit('<!DOCTYPE html>\n<html><head><title>'), escape(F.col("act_id")), F.lit('</title><meta http-equiv="Content-Type" content="text/html; charset=utf-8"></head><body><div class="act_container">\n'))
    return _together(pieces.unionByName(after), "\n", part_chars, (head, F.lit("\n</div></body></html>"))).select("act_id", "part", F.col("document").alias("html"))


_KEPT = ("kind", "identifier", "title", "special", "text", "intro", "wrap_up")


def _nest(rows: list[dict]) -> list[dict]:
    """One top element with all below it as JSON; rows come in document order, so a node's parent is the last one above its depth."""
    open_nodes: list[tuple[int, dict]] = []
    top: dict | None = None
    for r in rows:
        node = {"__type__": r["kind"]} | {c: r[c] for c in _KEPT[1:] if r[c] is not None} | (json.loads(r["more"]) if r["more"] else {})
        while open_nodes and open_nodes[-1][0] >= r["depth"]:
            open_nodes.pop()
        if open_nodes:
            open_nodes[-1][1].setdefault("children", []).append(node)
        else:
            top = node
        open_nodes.append((r["depth"], node))
    return [{"act_id": rows[0]["act_id"], "top": rows[0]["top"], "node": json.dumps(top, ensure_ascii=False)}]


#: What the semantic pass finds, by the key it has in an element's JSON.
SEMANTIC_KEYS = ("outgoing_references", "act_id_abbreviations", "semantic_data")


def _semantic_columns(semantics: Semantics) -> DataFrame:
    """act_id, element_id, more: the citations, abbreviations and records of each element as one JSON object."""
    tables = dict(zip(SEMANTIC_KEYS, (semantics.citations, semantics.abbreviations, semantics.records), strict=True))
    keyed = None
    for name, df in tables.items():
        own = F.struct(*(c for c in df.columns if c not in ("act_id", "element_id", "path")))
        rows = df.select("act_id", "element_id", *((F.when(F.lit(n == name), F.struct("seq", F.to_json(own).alias("j")))).alias(n) for n in SEMANTIC_KEYS))
        keyed = rows if keyed is None else keyed.unionByName(rows)
    listed = lambda n: F.concat(F.lit(f'"{n}":['), F.array_join(F.transform(F.array_sort(F.collect_list(n)), lambda x: x["j"]), ","), F.lit("]"))
    by = keyed.groupBy("act_id", "element_id").agg(*(F.when(F.count(n) > 0, listed(n)).alias(n) for n in SEMANTIC_KEYS))
    return by.select("act_id", "element_id", F.concat(F.lit("{"), F.concat_ws(",", *SEMANTIC_KEYS), F.lit("}")).alias("more"))


def nested_json(elements: DataFrame, part_chars: int = PART_CHARS, semantics: Semantics | None = None) -> DataFrame:
    """act_id, part, json: every act as an array of nested objects with `__type__`; nulls are left out. Elements have what the semantic
    pass found in them under SEMANTIC_KEYS. Top elements are nested by themselves, and only their strings meet to make the act's array, or
    its parts of an array each."""
    rows = elements.select("act_id", "element_id", F.col("path")[0].alias("top"), "path", "depth", *_KEPT)
    if semantics is None:
        rows = rows.withColumn("more", F.lit(None).cast("string"))
    else:
        rows = rows.join(_semantic_columns(semantics), ["act_id", "element_id"], "left")
    arrow = pa.schema([("act_id", pa.string()), ("top", pa.int32()), ("node", pa.string())])
    tops = map_groups(rows, ["act_id", "top"], ["path"], _nest, "act_id string, top int, node string", arrow)
    documents = _parts(tops.withColumnRenamed("node", "text"), ",", part_chars)
    return documents.select("act_id", "part", F.concat(F.lit("["), "document", F.lit("]")).alias("json"))


def read_semantics(documents: DataFrame) -> DataFrame:
    """act_id, part, node_path, kind, identifier, what, data of documents of nested_json(): what the semantic pass found, read back; data
    is a JSON object, node_path as in nested records. Documents that can't be read have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for act, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    stack = [(f"r.{i}", o) for i, o in enumerate(json.loads(text or "[]"), 1)]
                except ValueError:
                    stack = []
                while stack:
                    path, o = stack.pop()
                    rows += [(act, part, path, o["__type__"], o.get("identifier"), key, json.dumps(x, ensure_ascii=False)) for key in SEMANTIC_KEYS for x in o.get(key, ())]
                    stack += [(f"{path}.{i}", c) for i, c in enumerate(o.get("children", ()), 1)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.string(), pa.int32(), *[pa.string()] * 5]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["act_id", "part", "node_path", "kind", "identifier", "what", "data"])

    return documents.select("act_id", "part", "json").mapInArrow(run, "act_id string, part int, node_path string, kind string, identifier string, what string, data string")
