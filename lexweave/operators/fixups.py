"""Line patches as a table: replace, delete, or add an empty line after the line that matches.

Patches of an act apply one after the other, each to what those before it have left, and only if exactly one line matches. Only lines
that hold some patch's needle can change, so the patches are tried on these and the few lines before them, never on whole acts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.operators.groups import map_groups
from lexweave.operators.scans import previous
from lexweave.session import cut_lineage

MAX_CONTEXT = 9
_OUTCOME = "act_id {act}, line_no {line}, contents array<string>, seq {seq}, hits bigint"
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16()}


def _apply(rows: list[dict]) -> Iterator[dict]:
    """What the patches of one act make of its lines: changed lines with their new contents, and the hits of every patch.

    A line's contents are a list: empty if deleted, longer where empty lines follow it. rows: runs of consecutive lines, each long enough
    for every context of a line that can match; the first one has the act's patches.
    """
    act, patches = rows[0]["act_id"], sorted(rows[0]["patches"], key=lambda x: x["seq"])
    state = [[r["line_no"], [r["content"]], r["content"]] for r in rows if r["line_no"] is not None]
    unseen = {x["needle"]: x["unseen"] or 0 for x in patches}
    for x in patches:
        context = x["prev_lines"] or []
        flat: list[tuple[int, int, str]] = []
        found = []
        for i, (number, contents, _) in enumerate(state):
            if i and number != state[i - 1][0] + 1:
                flat = []  # lines in between aren't here, and no context reaches over them
            for k, c in enumerate(contents):
                if c == x["needle"] and (not context or [f[2] for f in flat[-len(context) :]] == context):
                    found.append((i, k))
                flat.append((i, k, c))
        hits = len(found) + (0 if context else unseen[x["needle"]])
        yield {"act_id": act, "seq": x["seq"], "hits": hits}
        if hits == 1 and found:
            i, k = found[0]
            own = state[i][1]
            if x["op"] == "empty_after":
                own.insert(k + 1, "")
            elif x["op"] == "delete" or not x["replacement"]:
                del own[k]
            else:
                own[k] = x["replacement"]
    yield from ({"act_id": act, "line_no": n, "contents": c} for n, c, was in state if c != [was])


def outcome(lines: DataFrame, fixups: DataFrame) -> DataFrame:
    """act_id, line_no and contents of every line that the patches change, and act_id, seq and hits of every patch.

    fixups: act_id, seq, op, needle, replacement, prev_lines (null or empty: any; else the contents of the lines right before, in order).
    Of lines that match a patch without context no more are looked at than the act has patches, and two: every patch takes away one at
    most, so where there are more it fails, and the others only count.
    """
    patch = fixups.select("act_id", F.struct("seq", "op", "needle", "replacement", F.coalesce("prev_lines", F.array().cast("array<string>")).alias("prev_lines")).alias("x"))
    by_act = patch.groupBy("act_id").agg(F.count("*").alias("n"), F.max(F.size("x.prev_lines")).alias("longest"))
    by_needle = patch.groupBy("act_id", F.col("x.needle").alias("content")).agg(F.min(F.size("x.prev_lines")).alias("least"), F.collect_set(F.get("x.prev_lines", F.size("x.prev_lines") - 1)).alias("before"))
    needles = by_needle.join(by_act, "act_id").select(F.col("act_id").alias("n_act"), F.col("content").alias("n_content"), "n", "longest", (F.col("least") == 0).alias("free"), "before")
    plain = lines.select("act_id", "line_no", "content")
    same = cut_lineage(plain.join(needles, (F.col("act_id") == F.col("n_act")) & (F.col("content") == F.col("n_content"))).drop("n_act", "n_content"))
    # A context can only hold if the line before is the last of it, or may become so because it can change itself.
    above = plain.select("act_id", (F.col("line_no") + 1).alias("line_no"), F.col("content").alias("above"))
    touched = same.select("act_id", (F.col("line_no") + 1).alias("line_no"), F.lit(True).alias("touched"))
    seen = same.join(above, ["act_id", "line_no"], "left").join(touched, ["act_id", "line_no"], "left")
    may = seen.withColumn("by_context", F.coalesce(F.array_contains("before", F.col("above")), F.lit(False)) | F.coalesce("touched", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("act_id", "content", "by_context").orderBy("line_no"))
    kept = may.withColumn("rank", rank).where("by_context OR (free AND rank <= n + 2)").select("act_id", "line_no", "content", (F.col("n") + F.col("longest")).alias("reach"))
    all_of = same.groupBy("act_id", "content").agg(F.count("*").alias("all"))
    some_of = kept.groupBy("act_id", "content").agg(F.count("*").alias("some"))
    unseen = all_of.join(some_of, ["act_id", "content"], "left").select("act_id", F.col("content").alias("needle"), (F.col("all") - F.coalesce("some", F.lit(0))).alias("unseen"))
    numbers = kept.select("act_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("line_no") - F.col("reach")), F.col("line_no"))).alias("line_no")).distinct()
    stretch = plain.join(numbers, ["act_id", "line_no"])
    listed = patch.select("act_id", F.col("x.needle").alias("needle"), "x").join(unseen, ["act_id", "needle"], "left")
    patches = listed.groupBy("act_id").agg(F.collect_list(F.struct("x.seq", "x.op", "x.needle", "x.replacement", "x.prev_lines", "unseen")).alias("patches"))
    # Every act with patches has a first row that carries them, though no line may match.
    rows = patches.select("act_id", F.lit(None).cast(plain.schema["line_no"].dataType).alias("line_no"), F.lit(None).cast("string").alias("content"), "patches")
    both = rows.unionByName(stretch.withColumn("patches", F.lit(None).cast(rows.schema["patches"].dataType)))
    names = {"act": plain.schema["act_id"].dataType.simpleString(), "line": plain.schema["line_no"].dataType.simpleString(), "seq": fixups.schema["seq"].dataType.simpleString()}
    arrow = pa.schema([("act_id", _TYPES[names["act"]]), ("line_no", _TYPES[names["line"]]), ("contents", pa.list_(pa.string())), ("seq", _TYPES[names["seq"]]), ("hits", pa.int64())])
    return map_groups(both, ["act_id"], ["line_no"], _apply, _OUTCOME.format(**names), arrow)


def apply_fixups(lines: DataFrame, fixups: DataFrame) -> DataFrame:
    """act_id, line_no, sub_no, content after the patches. Patches that don't hit exactly one line are not applied (see failed_fixups).

    Defined cases: patches apply in the order of seq, to the lines as the ones before left them; a null or empty replacement deletes the
    line; lines without a patch stay; patches of an act without lines hit nothing; null contents match no needle.
    """
    changed = outcome(lines, fixups).where("contents IS NOT NULL").select("act_id", "line_no", "contents")
    joined = lines.join(changed, ["act_id", "line_no"], "left")
    return joined.select("act_id", "line_no", F.posexplode(F.coalesce("contents", F.array("content"))).alias("sub_no", "content"))


def failed_fixups(lines: DataFrame, fixups: DataFrame) -> DataFrame:
    """act_id, seq, hits of the patches that hit no line or more than one when their turn came."""
    return outcome(lines, fixups).where("seq IS NOT NULL AND hits <> 1").select("act_id", "seq", "hits")


def bracketed_titles(lines: DataFrame) -> DataFrame:
    """act_id, line_no, content with a bracketed line before an article moved into it as its title: `(T)`, `2. § B` to `2. § [T]`, `B`."""
    before = previous(lines, ["act_id"], "line_no", ["content"])
    title, article = r"^[\[(](.*)[)\]]$", r"^([0-9]+\. § )(.*)$"
    hit = F.coalesce(F.col("content").rlike(article) & F.col("prev_content").rlike(title), F.lit(False))
    marked = before.withColumn("hit", hit)
    moved = marked.where("hit").select("act_id", (F.col("line_no") - 1).alias("line_no"), F.concat(F.regexp_extract("content", article, 1), F.lit("["), F.regexp_extract("prev_content", title, 1), F.lit("]")).alias("new"))
    kept = marked.join(moved, ["act_id", "line_no"], "left")
    return kept.select("act_id", "line_no", F.coalesce("new", F.when(F.col("hit"), F.regexp_extract("content", article, 2)), "content").alias("content"))


def make_fixups(before: DataFrame, after: DataFrame) -> DataFrame:
    """Patches (act_id, seq, op, needle, replacement, prev_lines) that turn lines into their edited form, line by line (an empty edit
    deletes): with as few lines of context, up to MAX_CONTEXT, as make each hit its line alone when its turn comes. What stays ambiguous
    has null prev_lines. line_no is dense.

    Patches are numbered (by negative line numbers) from the last line of an act to the first, so that the lines above a patch stand as they did before. The lines
    above come from one join of rivals (lines with the content of a changed one) with the numbers of the lines they look back on.
    """
    new = after.select("act_id", "line_no", F.col("content").alias("edited"))
    changed = before.join(new, ["act_id", "line_no"]).where("content <> edited")
    # All lines with the content of a changed one compete with it.
    rivals = before.select("act_id", "line_no", "content").join(changed.select("act_id", "content").distinct(), ["act_id", "content"], "left_semi")
    looks = rivals.select("act_id", F.col("line_no").alias("at"), "content", F.explode(F.sequence(F.lit(0), F.lit(MAX_CONTEXT))).alias("back"))
    above = before.select("act_id", F.col("line_no").alias("at_back"), F.col("content").alias("above"))
    joined = looks.withColumn("at_back", F.col("at") - F.col("back")).join(above, ["act_id", "at_back"], "left")
    context = joined.groupBy("act_id", "at", "content").agg(F.array_sort(F.collect_list(F.when((F.col("back") > 0) & F.col("above").isNotNull(), F.struct("back", "above")))).alias("ups"))
    lengths = F.explode(F.sequence(F.lit(0), F.size("ups"))).alias("k")
    every = context.select("act_id", F.col("at").alias("line_no"), "content", "ups", lengths).withColumn("prev_lines", F.reverse(F.transform(F.slice("ups", 1, F.col("k")), lambda u: u["above"])))
    unique = every.groupBy("act_id", "content", F.xxhash64("prev_lines").alias("h"), "prev_lines").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    least = unique.where("n = 1").groupBy("act_id", "line_no").agg(F.min_by("prev_lines", F.size("prev_lines")).alias("prev_lines"))
    seq = changed.withColumn("seq", -F.col("line_no"))
    return seq.join(least, ["act_id", "line_no"], "left").select("act_id", "seq", F.when(F.col("edited") == "", F.lit("delete")).otherwise(F.lit("replace")).alias("op"), F.col("content").alias("needle"), F.col("edited").alias("replacement"), "prev_lines")


class Registry:
    """Patches and functions by act, in the order they were added: registry.add(act_id, op, needle, …) or registry.call(act_id, function).

    A function takes the act's lines (act_id, line_no, content) as a table and gives them changed, with line_no in their new order.
    """

    def __init__(self) -> None:
        self.steps: dict[str, list[tuple | Callable[[DataFrame], DataFrame]]] = {}

    def add(self, act_id: str, op: str, needle: str, replacement: str | None = None, prev_lines: list[str] | None = None) -> None:
        self.steps.setdefault(act_id, []).append((op, needle, replacement, prev_lines))

    def call(self, act_id: str, function: Callable[[DataFrame], DataFrame]) -> None:
        self.steps.setdefault(act_id, []).append(function)

    def table(self, spark: SparkSession) -> DataFrame:
        """The patches as a table, numbered within their act; functions have none."""
        rows = [(act, n, *x) for act, steps in self.steps.items() for n, x in enumerate(steps, 1) if isinstance(x, tuple)]
        return spark.createDataFrame(rows, "act_id string, seq int, op string, needle string, replacement string, prev_lines array<string>")

    def apply(self, lines: DataFrame) -> DataFrame:
        """act_id, line_no, content of all acts: all patches first, then each act's functions in turn; line_no is of the table given."""
        patched = apply_fixups(lines.select("act_id", "line_no", "content"), self.table(lines.sparkSession))
        numbered = patched.select("act_id", (F.col("line_no").cast("bigint") * 4_096 + F.col("sub_no")).alias("line_no"), "content")
        for act, steps in self.steps.items():
            functions = [x for x in steps if not isinstance(x, tuple)]
            if functions:
                own, others = numbered.where(F.col("act_id") == act), numbered.where(~F.col("act_id").eqNullSafe(F.lit(act)))
                for f in functions:
                    own = f(own)
                numbered = others.unionByName(own)
        return numbered
