"""References as structs, and their algebra as Column expressions.

A reference is struct<act, article, paragraph, point, subpoint>; each level below the act is struct<first,last>, alike for a single
identifier, null where the reference doesn't say. Everything stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.identifiers import natural_key

LEVELS = ("article", "paragraph", "point", "subpoint")
ALL = ("act", *LEVELS)
LEVEL_TYPE = "struct<first:string,last:string>"
REF_TYPE = f"struct<act:string,{','.join(f'{x}:{LEVEL_TYPE}' for x in LEVELS)}>"


def _let(value: Column, body) -> Column:
    """body of value, which is computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def level(first: Column, last: Column | None = None) -> Column:
    """One level from its identifiers; null if the first is."""
    return F.when(first.isNotNull(), F.struct(first.alias("first"), F.coalesce(last, first).alias("last") if last is not None else first.alias("last"))).cast(LEVEL_TYPE)


def ref(act: Column | None = None, **levels: Column | None) -> Column:
    """A reference from an act id and levels made by level()."""
    null = F.lit(None)
    parts = [(null if act is None else act).cast("string").alias("act")]
    parts += [(null if levels.get(x) is None else levels[x]).cast(LEVEL_TYPE).alias(x) for x in LEVELS]
    return F.struct(*parts).cast(REF_TYPE)


def relative_to(mine: Column, other: Column) -> Column:
    """What a reference leaves out before its first given level comes from the other; the rest is its own, nulls included."""
    parts, given = [], F.lit(False)
    for x in ALL:
        given = given | mine[x].isNotNull()
        parts.append(F.when(given, mine[x]).otherwise(other[x]).alias(x))
    return F.struct(*parts).cast(REF_TYPE)


def endpoint(r: Column, which: str) -> Column:
    """The first or last of a range, as a reference of single identifiers."""
    return ref(r["act"], **{x: level(r[x][which]) for x in LEVELS})


def make_range(first: Column, last: Column) -> Column:
    """The range from one reference to another of the same depth."""
    return ref(first["act"], **{x: level(first[x]["first"], last[x]["last"]) for x in LEVELS})


def parent(r: Column) -> Column:
    """The reference without its deepest level."""
    parts = []
    for i, x in enumerate(ALL):
        below = [r[y].isNotNull() for y in ALL[i + 1 :]]
        deeper = below[0] if below else F.lit(False)
        for b in below[1:]:
            deeper = deeper | b
        parts.append(F.when(deeper, r[x]).alias(x))
    return F.struct(*parts).cast(REF_TYPE)


def sort_key(r: Column, which: str = "first") -> Column:
    """Orders references: levels by natural order, a missing one before any, so a parent comes before its children."""
    keys = [F.coalesce(natural_key(r["act"]), F.array().cast("array<struct<s:string,n:bigint>>"))]
    keys += [F.coalesce(natural_key(r[x][which]), F.array().cast("array<struct<s:string,n:bigint>>")) for x in LEVELS]
    return F.array(*keys)


def is_parent_of(a: Column, b: Column) -> Column:
    """Do two keys name an ancestor and one of its descendants?"""
    depth = F.aggregate(a, F.struct(F.lit(0).alias("i"), F.lit(0).alias("d")), lambda s, x: F.struct((s["i"] + 1).alias("i"), F.when(F.size(x) > 0, s["i"] + 1).otherwise(s["d"]).alias("d")), lambda s: s["d"])
    return _let(F.struct(a.alias("a"), b.alias("b"), depth.alias("d")), lambda k: (k["a"] != k["b"]) & ((k["d"] == 0) | (F.slice(k["a"], 1, F.greatest(k["d"], F.lit(1))) == F.slice(k["b"], 1, F.greatest(k["d"], F.lit(1))))))


def contains(outer: Column, inner: Column) -> Column:
    """Does a (range of) places hold another, whatever their depths?"""
    keys = F.struct(sort_key(outer).alias("lo"), sort_key(outer, "last").alias("hi"), sort_key(inner).alias("first"), sort_key(inner, "last").alias("last"))
    return _let(keys, lambda k: ((k["lo"] <= k["first"]) | is_parent_of(k["lo"], k["first"])) & ((k["hi"] >= k["last"]) | is_parent_of(k["hi"], k["last"])))


def is_relative(r: Column) -> Column:
    return r["act"].isNull()


def is_range(r: Column) -> Column:
    out = F.lit(False)
    for x in LEVELS:
        out = out | F.coalesce(r[x]["first"] != r[x]["last"], F.lit(False))
    return out


def _written(part: Column) -> Column:
    safe = lambda c: F.replace(F.replace(c, F.lit("/"), F.lit("slash")), F.lit(":"), F.lit("colon"))
    return F.when(part.isNull(), F.lit("")).when(part["first"] == part["last"], safe(part["first"])).otherwise(F.concat(safe(part["first"]), F.lit("-"), safe(part["last"])))


def id_string(r: Column) -> Column:
    """`article_paragraph_point_subpoint` with ranges as `x-y`; only letters, digits, `_` and `-`."""
    return F.concat_ws("_", *(_written(r[x]) for x in LEVELS))


def from_id_string(s: Column, act: Column | None = None) -> Column:
    """The inverse of id_string."""
    read = lambda c: F.replace(F.replace(c, F.lit("slash"), F.lit("/")), F.lit("colon"), F.lit(":"))

    def one(ends: Column) -> Column:
        return level(F.when(F.get(ends, 0) != "", F.get(ends, 0)), F.get(ends, F.size(ends) - 1))

    levels = F.transform(F.split(s, "_"), lambda p: one(F.split(read(p), "-")))
    return _let(levels, lambda v: ref(act, **{x: F.get(v, i) for i, x in enumerate(LEVELS)}))


def last_component(r: Column) -> Column:
    """struct<kind, first, last> of the deepest level given; points and subpoints that begin with a digit are numeric."""
    kinds = {"article": "Article", "paragraph": "Paragraph", "point": "Point", "subpoint": "Subpoint"}
    out = F.struct(F.when(r["act"].isNotNull(), F.lit("Act")).alias("kind"), r["act"].alias("first"), r["act"].alias("last"))
    for x in LEVELS:
        kind = F.lit(kinds[x]) if x in ("article", "paragraph") else F.concat(F.when(r[x]["first"].rlike("^[0-9]"), F.lit("Numeric")).otherwise(F.lit("Alphabetic")), F.lit(kinds[x]))
        out = F.when(r[x].isNotNull(), F.struct(kind.alias("kind"), r[x]["first"].alias("first"), r[x]["last"].alias("last"))).otherwise(out)
    return out


def href(r: Column) -> Column:
    """`<act>.html#<id string>`; without an act only the part after the mark."""
    return F.concat(F.coalesce(F.concat(r["act"], F.lit(".html")), F.lit("")), F.lit("#"), id_string(r))


def flat(r: Column, prefix: str = "") -> list[Column]:
    """A reference as plain columns."""
    return [r["act"].alias(f"{prefix}act"), *(r[x][e].alias(f"{prefix}{x}_{e}") for x in LEVELS for e in ("first", "last"))]


def of_columns(prefix: str = "") -> Column:
    """The inverse of flat."""
    c = lambda x: F.col(prefix + x)
    return ref(c("act"), **{x: level(c(f"{x}_first"), c(f"{x}_last")) for x in LEVELS})


def chain(df, keys: list[str], order: list[str], reference: Column):
    """Adds `resolved`: each reference of a group completed by those before it, in order.

    Equal to folding relative_to over the group, but as one running value per level: a level comes from the last reference that begins at
    it or above.
    """
    from pyspark.sql import Window

    first = F.lit(len(ALL))
    for i in range(len(ALL) - 1, -1, -1):
        first = F.when(reference[ALL[i]].isNotNull(), F.lit(i)).otherwise(first)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    with_first = df.withColumn("_ref", reference).withColumn("_first", first)
    parts = [F.last(F.when(F.col("_first") <= i, F.struct(F.col("_ref")[x].alias("v"))), ignorenulls=True).over(w)["v"].alias(x) for i, x in enumerate(ALL)]
    return with_first.withColumn("resolved", F.struct(*parts).cast(REF_TYPE)).drop("_ref", "_first")
