"""Acts as tables of elements: structure from lines, amendments opened, sentences in context, lookups and rewriting.

Structure is found in two steps so that an act of any size is spread over tasks: headings and articles are accepted from the few lines
that look like them; then each article is parsed by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.identifiers import natural_key
from lexweave.functions.text import fix_list_end, quote_change, split_amendment_intro
from lexweave.kernels import structure as S
from lexweave.kernels.citations import Ref, analyze
from lexweave.operators.groups import map_groups
from lexweave.operators.scans import BLOCK_ROWS, running_count, running_sum
from lexweave.session import cut_lineage

ELEMENTS_SCHEMA = "act_id string, element_no bigint, element_id string, parent_id string, kind string, ord int, depth int, path array<int>, identifier string, title string, special boolean, text string, intro string, wrap_up string, in_amendment boolean, quoted array<struct<content:string,indent:double>>, error string"
_ARROW = pa.schema([
    ("act_id", pa.string()), ("element_no", pa.int64()), *((c, pa.string()) for c in ("element_id", "parent_id", "kind")), ("ord", pa.int32()), ("depth", pa.int32()), ("path", pa.list_(pa.int32())),
    ("identifier", pa.string()), ("title", pa.string()), ("special", pa.bool_()), *((c, pa.string()) for c in ("text", "intro", "wrap_up")), ("in_amendment", pa.bool_()),
    ("quoted", pa.list_(pa.struct([("content", pa.string()), ("indent", pa.float64())]))), ("error", pa.string()),
])
#: What the first line of an article or heading looks like; finer rules follow in the kernel.
LOOKS_LIKE_HEADER = r"^([0-9]+:)?[0-9]+(/[A-Z])?\. ?§ +|KÖNYV$|RÉSZ$|\. CÍM$|\. [Ff][Ee][Jj][Ee][Zz][Ee][Tt]$"


def _quoted(lines: list[S.Line] | None) -> list[dict] | None:
    return None if lines is None else [{"content": x.content, "indent": x.indent} for x in lines]


def _line(r: dict) -> S.Line:
    gaps = tuple((g["at"], g["width"]) for g in r["gaps"] or ())
    return S.Line(r["content"], r["indent"], r["margin_right"], r["bold"], gaps)


def with_element_no(lines: DataFrame) -> DataFrame:
    """Adds element_no to act_id, line_no, content, indent, margin_right, bold, is_empty, gaps: the number of the article or heading that
    a line belongs to, 0 in the preamble. line_no is dense."""
    levels = running_sum(lines.withColumn("_change", quote_change(F.col("content"))), ["act_id"], "line_no", F.col("_change"), "quote_level", inclusive=False, also={"prev_is_empty": lambda w: F.lag("is_empty").over(w)})
    looks = levels.where((F.col("quote_level") == 0) & (F.col("content").rlike(LOOKS_LIKE_HEADER) | (F.col("bold") & ~F.col("is_empty")))).select("act_id", "line_no", "content", "indent", "bold", "prev_is_empty")
    # The first line of a block doesn't see the one before, which is the last of another block.
    last = lines.where(F.col("line_no") % BLOCK_ROWS == BLOCK_ROWS - 1).select(F.col("act_id").alias("l_act"), (F.col("line_no") + 1).alias("l_next"), F.col("is_empty").alias("l_empty"))
    candidates = looks.join(last, (F.col("act_id") == F.col("l_act")) & (F.col("line_no") == F.col("l_next")), "left").withColumn("prev_is_empty", F.coalesce("prev_is_empty", "l_empty")).drop("l_act", "l_next", "l_empty")

    def accept(found: list[dict]) -> Iterator[dict]:
        walk = S.Walk()
        for r in found:
            got = walk.accept(S.Line(r["content"], r["indent"], 0.0, r["bold"]), bool(r["prev_is_empty"]) or r["line_no"] == 0)
            if got:
                yield {"act_id": r["act_id"], "line_no": r["line_no"], "kind": got[0], "identifier": got[1], "special": got[2]}

    arrow = pa.schema([("act_id", pa.string()), ("line_no", pa.int32()), ("kind", pa.string()), ("identifier", pa.string()), ("special", pa.bool_())])
    accepted = map_groups(candidates, ["act_id"], ["line_no"], accept, "act_id string, line_no int, kind string, identifier string, special boolean", arrow)
    # Both the lines and the totals of their blocks need what was accepted, a row per article.
    begins = cut_lineage(accepted.select("act_id", "line_no", F.struct("kind", "identifier", "special").alias("begins")))
    return running_count(lines, ["act_id"], "line_no", begins, "element_no")


def _rows(found: list[dict]) -> Iterator[dict]:
    act_id, number, b = found[0]["act_id"], found[0]["element_no"], found[0]["begins"]
    base = {"act_id": act_id, "element_no": number}
    lines = [_line(r) for r in found]
    if number == 0:
        text = S.joined(lines)
        if text:
            yield base | {"element_id": "preamble", "kind": "Preamble", "ord": 0, "depth": 0, "path": [0], "text": text, "in_amendment": False}
        return
    try:
        e = S.structural(lines, b["kind"], b["identifier"], bool(b["special"]))
    except (S.StructureError, IndexError, TypeError) as x:
        yield base | {"element_id": f"error-{number}", "kind": b["kind"], "identifier": b["identifier"], "ord": number, "depth": 0, "path": [number], "in_amendment": False, "error": str(x)[:500]}
        return
    for row in S.flatten([e]):
        top = row["depth"] == 0
        if top and row["kind"] != "Article":
            row["element_id"] = f"{row['kind'].lower()}-{number}"
        row["ord"], row["path"] = (number if top else row["ord"]), [number, *row["path"][1:]]
        yield base | row | {"quoted": _quoted(row.pop("lines"))}


def parse_acts(lines: DataFrame) -> DataFrame:
    """The elements of acts, with ELEMENTS_SCHEMA, from their lines.

    Defined cases: an act without any header is all preamble; an article that can't be parsed (unbalanced quotes, an endless title) is a
    row with `error` and doesn't touch the others; empty lines belong to what stands before.
    """

    return map_groups(with_element_no(lines), ["act_id", "element_no"], ["line_no"], _rows, ELEMENTS_SCHEMA, _ARROW)


def with_id_key(elements: DataFrame) -> DataFrame:
    return elements.withColumn("id_key", natural_key(F.col("identifier")))


def cut_by_identifier(elements: DataFrame, ranges: DataFrame) -> DataFrame:
    """Elements whose identifier lies between two, ends included, in natural order. ranges: range_id, act_id, parent_id, first, last.

    An equi-join on act and parent, the range is a condition on top: no act meets another.
    """
    r = ranges.select("range_id", F.col("act_id").alias("r_act"), F.col("parent_id").alias("r_parent"), natural_key(F.col("first")).alias("lo"), natural_key(F.col("last")).alias("hi"))
    on = (F.col("act_id") == F.col("r_act")) & F.col("parent_id").eqNullSafe(F.col("r_parent")) & F.col("id_key").between(F.col("lo"), F.col("hi"))
    return with_id_key(elements).join(r, on).drop("r_act", "r_parent", "lo", "hi", "id_key")


def ancestors(elements: DataFrame, keys: tuple[str, str] = ("act_id", "element_id")) -> DataFrame:
    """act, id, ancestor, level (1 for the parent) of every element and all it stands in, as deep as the elements are.

    Only ids are joined, one level at a time, until none has anything above it. An element that would stand below itself ends there.
    """
    act, own = keys
    up = elements.select(F.col(act).alias("u_act"), F.col(own).alias("u_id"), F.col("parent_id").alias("u_parent")).where("u_parent IS NOT NULL").distinct()
    level = cut_lineage(up.select(F.col("u_act").alias("act"), F.col("u_id").alias("id"), F.col("u_parent").alias("ancestor"), F.lit(1).alias("level"), F.array("u_id", "u_parent").alias("seen")))
    found = level
    while not level.isEmpty():
        above = level.join(up, (F.col("act") == F.col("u_act")) & (F.col("ancestor") == F.col("u_id"))).where(~F.array_contains("seen", F.col("u_parent")))
        level = cut_lineage(above.select("act", "id", F.col("u_parent").alias("ancestor"), (F.col("level") + 1).alias("level"), F.concat("seen", F.array("u_parent")).alias("seen")))
        found = found.unionByName(level)
    return found.drop("seen")


def with_context(elements: DataFrame, keys: tuple[str, str] = ("act_id", "element_id")) -> DataFrame:
    """Adds prefix, postfix and sentence: an element's text (or intro) between the intros and wrap-ups of all it stands in.

    What stands above comes from ids alone; then one join brings the intros and wrap-ups of those that have any, and one puts them beside
    their elements. An element without ancestors keeps its own text. In amendments context ends at the block.
    """
    act, own = keys
    around = elements.where("intro IS NOT NULL OR wrap_up IS NOT NULL").select(F.col(act).alias("u_act"), F.col(own).alias("u_id"), F.col("intro").alias("u_intro"), F.col("wrap_up").alias("u_wrap"))
    parts = ancestors(elements, keys).join(around, (F.col("act") == F.col("u_act")) & (F.col("ancestor") == F.col("u_id")))
    # Of the rows above an element there are as many as it is deep.
    by = parts.groupBy("act", "id").agg(F.array_sort(F.collect_list(F.struct("level", "u_intro", "u_wrap"))).alias("ups"))
    told = lambda c: F.filter(F.transform("ups", lambda u: u[c]), lambda x: x.isNotNull())
    glued = by.select(
        F.col("act").alias("c_act"), F.col("id").alias("c_id"), F.array_join(F.transform(F.reverse(told("u_intro")), lambda x: F.concat(x, F.lit(" "))), "").alias("c_prefix"), F.array_join(F.transform(told("u_wrap"), lambda x: F.concat(F.lit(" "), x)), "").alias("c_postfix")
    )
    out = elements.join(glued, (F.col(act) == F.col("c_act")) & (F.col(own) == F.col("c_id")), "left").withColumn("prefix", F.coalesce("c_prefix", F.lit(""))).withColumn("postfix", F.coalesce("c_postfix", F.lit(""))).drop("c_act", "c_id", "c_prefix", "c_postfix")
    is_text = F.col("text").isNotNull()
    post = F.when(is_text, F.col("postfix")).otherwise(F.lit(""))
    middle = F.coalesce("text", "intro")
    fixed = F.when(post == "", fix_list_end(middle)).otherwise(fix_list_end(middle, False))
    return out.withColumn("postfix", post).withColumn("sentence", F.concat("prefix", fixed, "postfix"))


def open_amendments(elements: DataFrame) -> DataFrame:
    """The rows that replace quoted blocks whose paragraph amends another act: a BlockAmendmentContainer and its parsed elements.

    A paragraph with several blocks, or whose block can't be parsed, keeps its quoted blocks and gives a row with `error`.
    """
    intro, context = split_amendment_intro(F.col("intro"))
    para = elements.where("kind = 'Paragraph' AND intro IS NOT NULL").select("act_id", "element_no", F.col("element_id").alias("p_id"), "depth", F.col("path").alias("p_path"), intro.alias("p_intro"), context.alias("p_context"), F.col("wrap_up").alias("p_wrap"))
    blocks = elements.where("kind = 'QuotedBlock'").select("act_id", F.col("parent_id").alias("p_id"), "quoted", "ord")
    one = para.join(blocks.groupBy("act_id", "p_id").agg(F.count("*").alias("n"), F.min_by("quoted", "ord").alias("quoted")), ["act_id", "p_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pa.Table.from_pylist([x for r in batch.to_pylist() for x in _amendment(r)], schema=_ARROW).to_batches()

    return one.mapInArrow(run, ELEMENTS_SCHEMA)


def _amendment(r: dict) -> Iterator[dict]:
    record = next((x for x in analyze(r["p_intro"]).records if x.kind == "BlockAmendment"), None)
    if record is None:
        return
    base = {"act_id": r["act_id"], "element_no": r["element_no"]}
    name, depth, path = r["p_id"] + ".amendment", int(r["depth"]) + 1, [*r["p_path"], 1]
    try:
        if r["n"] != 1:
            raise S.StructureError(f"{r['n']} quoted blocks")
        lines = [S.Line(x["content"], x["indent"]) for x in r["quoted"]]
        if record.structural:
            children = S.act(lines, strict=False, indented=False)[1]
        else:
            kind, expected = _target(record.ref)
            children = S.amendment_block(lines, kind, expected)
    except (S.StructureError, IndexError, TypeError) as x:
        yield base | {"element_id": name, "parent_id": r["p_id"], "kind": "BlockAmendmentContainer", "ord": 1, "depth": depth, "path": path, "in_amendment": True, "error": str(x)[:500]}
        return
    yield base | {"element_id": name, "parent_id": r["p_id"], "kind": "BlockAmendmentContainer", "ord": 1, "depth": depth, "path": path, "intro": r["p_context"], "wrap_up": (r["p_wrap"] or "")[1:-1] or None if r["p_context"] else None, "in_amendment": True}
    for row in S.flatten(children, ("", "", "", ""), None, depth + 1, (), f"{name}/"):
        yield base | row | {"parent_id": row["parent_id"] or name, "path": [*path, *row["path"]], "in_amendment": True, "quoted": _quoted(row.pop("lines"))}


def _target(ref: Ref) -> tuple[str, str]:
    names = ("Article", "Paragraph", "Point", "Subpoint")
    slot = max(i for i, v in enumerate(ref[1:]) if v)
    first = ref[1 + slot][0]
    return names[slot] if slot < 2 else ("Numeric" if first[0].isdigit() else "Alphabetic") + names[slot], first


def map_elements(elements: DataFrame, change: Callable[[DataFrame], dict[str, Column]], where: Column | None = None) -> DataFrame:
    """Rewrites columns of the elements that a condition picks; the others stay. Order doesn't matter, each row is changed by itself."""
    new = change(elements)
    picked = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return elements.withColumns({c: F.when(picked, v).otherwise(F.col(c)) for c, v in new.items()})


def map_trees(elements: DataFrame, change: Callable[[dict], dict | list[dict] | None], children_first: bool = False) -> DataFrame:
    """Rewrites the trees of articles and headings: elements may be changed, dropped, added and put in another order.

    change gets an element as a dict of its columns, with its children (dicts alike) under `children`, and gives it changed, a list to
    stand in its place, or nothing to drop it and all below. It sees an element before those below it, or after them with children_first.
    What stands below is numbered anew: ord, depth, path and parent_id follow from the tree; element_id is kept, and must be given to
    added ones. Top elements keep their number; of several in the place of one, the further ones get it too. Trees are mapped one by one.
    """

    def walk(node: dict) -> list[dict]:
        if children_first:
            node = node | {"children": [x for c in node["children"] for x in walk(c)]}
        got = change(node)
        found = got if isinstance(got, list) else [] if got is None else [got]
        if children_first:
            return found
        return [x | {"children": [y for c in x.get("children", ()) for y in walk(c)]} for x in found]

    def number(node: dict, above: dict | None, place: int) -> Iterator[dict]:
        placed = {"path": [*above["path"], place], "ord": place, "depth": above["depth"] + 1, "parent_id": above["element_id"]} if above else {}
        row = {n: node.get(n) for n in _ARROW.names} | placed
        if above:
            row |= {"act_id": above["act_id"], "element_no": above["element_no"]}
        yield row
        for i, c in enumerate(node.get("children", ()), 1):
            yield from number(c, row, i)

    def tree(rows: list[dict]) -> Iterator[dict]:
        tops: list[dict] = []
        by_path: dict[tuple, dict] = {}
        for r in sorted(rows, key=lambda r: r["path"]):
            node = r | {"children": []}
            by_path[tuple(r["path"])] = node
            above = by_path.get(tuple(r["path"][:-1]))
            (above["children"] if above else tops).append(node)
        for top in tops:
            for x in walk(top):
                yield from number(x, None, 0)

    plain = elements.select(*_ARROW.names).withColumn("_top", F.col("path")[0])
    return map_groups(plain, ["act_id", "_top"], ["path"], tree, ELEMENTS_SCHEMA, _ARROW)


def subtree(elements: DataFrame, roots: DataFrame) -> DataFrame:
    """Elements that are, or stand below, one of the roots (act_id, root_id, root_path): their paths begin with the root's.

    Paths are spread into their prefixes, so act and path meet in an equi-join; only the paths are spread, not the texts.
    """
    r = roots.select(F.col("act_id").alias("r_act"), "root_id", "root_path")
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k)))
    spread_out = elements.where(F.size("path") > 0).select("act_id", "path", prefixes.alias("_prefix")).distinct()
    below = spread_out.join(r, (F.col("act_id") == F.col("r_act")) & (F.col("_prefix") == F.col("root_path"))).select("act_id", "path", "root_id")
    return elements.join(below, ["act_id", "path"])


def invariants(elements: DataFrame) -> DataFrame:
    """act_id, element_id, violation: elements with text beside intro or wrap-up, children beside text, or an unnumbered paragraph
    among several."""
    kids = elements.groupBy("act_id", F.col("parent_id").alias("element_id")).agg(F.count("*").alias("n"), F.sum((F.col("kind").eqNullSafe("Paragraph") & F.col("identifier").isNull()).cast("int")).alias("unnumbered"))
    with_kids = elements.select("act_id", "element_id", "kind", "text", "intro", "wrap_up").join(kids, ["act_id", "element_id"], "left")
    found = F.array_compact(F.array(
        F.when(F.col("text").isNotNull() & (F.col("intro").isNotNull() | F.col("wrap_up").isNotNull()), F.lit("text beside intro or wrap-up")),
        F.when(F.col("text").isNotNull() & (F.col("n") > 0), F.lit("text beside children")),
        F.when((F.col("kind") == "Article") & (F.col("n") > 1) & (F.col("unnumbered") > 0), F.lit("unnumbered paragraph among several")),
    ))
    return with_kids.select("act_id", "element_id", F.explode(found).alias("violation"))


def at_reference(elements: DataFrame, references: DataFrame) -> DataFrame:
    """Elements that references name: ref_id, act_id, element_id. references: ref_id, reference (a struct of operators.refs).

    Only the deepest level of a reference may be a range, which is taken in natural order; what isn't found gives no row. An equi-join
    on act, depth and the place above. An unnumbered paragraph has no reference of its own; what stands below it is named without it.
    """
    from lexweave.operators import refs as R

    def placed(df: DataFrame, r: Column, *keep: Column) -> DataFrame:
        with_ref = df.select(*keep, r.alias("_r"))
        last = R.last_component(F.col("_r"))
        return with_ref.select(*(c for c in with_ref.columns if c != "_r"), F.col("_r.act").alias("_act"), last["kind"].alias("_kind"), R.id_string(R.parent(F.col("_r"))).alias("_above"), natural_key(last["first"]).alias("_lo"), natural_key(last["last"]).alias("_hi"))

    own = R.from_id_string(F.regexp_replace(F.col("element_id"), "^([^_]*)_0_", "$1__"), F.col("act_id"))
    named = F.col("element_id").rlike("^[^_.]*_[^_.]*_[^_.]*_[^_.]*$") & ~F.col("element_id").rlike("^[^_]*_0__$")
    e = placed(elements.where(named), own, F.col("act_id"), F.col("element_id"))
    r = placed(references, F.col("reference"), F.col("ref_id"))
    on = (e["_act"] == r["_act"]) & (e["_kind"] == r["_kind"]) & (e["_above"] == r["_above"]) & (e["_lo"] >= r["_lo"]) & (e["_lo"] <= r["_hi"])
    return e.join(r, on).select("ref_id", "act_id", "element_id")
