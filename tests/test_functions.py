import itertools
import random

from pyspark.sql import functions as F

from lexweave.functions import dates, identifiers, numerals, text
from lexweave.kernels import citations as C
from lexweave.kernels import identifiers as K
from lexweave.operators import refs

IDS = ["1", "1a", "1A", "1b", "1/A", "1/B", "2", "2a", "9", "10", "a", "b", "g", "gy", "h", "ny", "o", "ba", "bb", "ca", "2:1", "2:2", "3:1", "x1", ""]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_succession_equals_kernel(spark):
    kinds = ["Article", "Paragraph", "AlphabeticPoint", "AlphabeticSubpoint", "NumericPoint"]
    cases = [(k, a, b) for k in kinds for a, b in itertools.product(IDS, IDS)]
    df = spark.createDataFrame(cases, "k string, a string, b string")
    got = rows(df.select("k", "a", "b", identifiers.next_identifier(F.col("k"), F.col("a"), F.col("b"))))
    wrong = [g for g in got if g[3] != bool(g[1] and g[2] and K.next_identifier(g[0], g[1], g[2]))]
    assert not wrong


def test_natural_key_orders_as_kernel(spark):
    df = spark.createDataFrame([(i,) for i in IDS if i], "i string")
    assert [r[0] for r in df.orderBy(identifiers.natural_key(F.col("i"))).collect()] == sorted((i for i in IDS if i), key=K.natural_key)


def test_numerals(spark):
    df = spark.range(-1, 4100).select(F.col("id").alias("n"))
    got = rows(df.select("n", numerals.roman_value(numerals.roman(F.col("n"))), numerals.ordinal_value(numerals.ordinal_word(F.col("n")))))
    assert all(v == (n if n > 0 else None) and o == (n if 1 <= n <= 100 else None) for n, v, o in got)
    odd = spark.createDataFrame([("VI/A",), ("",), ("x",), (None,)], "s string").select(numerals.roman_to_arabic(F.col("s")), numerals.roman_value(F.col("s")))
    assert rows(odd) == [("6/A", None), (None, None), (None, None), (None, None)]
    assert rows(spark.createDataFrame([("12/A",), ("A",), (None,)], "s string").select(numerals.arabic_to_roman(F.col("s")))) == [("XII/A",), (None,), (None,)]


def test_dates(spark):
    df = spark.createDataFrame([("2011. június 28., kedd",), ("2011. június 31.",), ("2011. foo 3.",), ("",), (None,), ("2011.6.28.",), ("2011/6/28",), ("2011.13.1",)], "s string")
    got = rows(df.select(dates.hungarian_date(F.col("s")).cast("string"), dates.simple_date(F.col("s")).cast("string")))
    assert got == [("2011-06-28", None), (None, None), (None, None), (None, None), (None, None), (None, "2011-06-28"), (None, "2011-06-28"), (None, None)]


def test_text(spark):
    df = spark.createDataFrame([("a, és",), ("a; és,",), ("a.",), ("a",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(text.fix_list_end(F.col("s"))).collect()] == ["a.", "a; és.", "a.", "a.", ".", None]
    joined = spark.createDataFrame([(["a-", "b", "", None, "c"],), ([],), (None,)], "l array<string>").select(text.join_lines(F.col("l")))
    assert [r[0] for r in joined.collect()] == ["a-b c", "", None]
    intro, context = text.split_amendment_intro(F.col("s"))
    two = spark.createDataFrame([("A lép: (ha igen)",), ("A lép:",), ("A lép:[x]",), (None,)], "s string").select(intro, context)
    assert rows(two) == [("A lép:", "ha igen"), ("A lép:", None), ("A lép:", "x"), (None, None)]
    parts = spark.createDataFrame([([(5.0, "ab", True), (3.0, "c", False)],), ([],)], "p array<struct<dx:double,content:string,bold:boolean>>")
    assert rows(parts.select(text.line_content(F.col("p")), text.line_indent(F.col("p")), text.line_bold(F.col("p")))) == [("abc", 5.0, True), ("", 0.0, False)]
    assert rows(spark.createDataFrame([("„ a ”",)], "s string").select(text.unquote(F.col("s")), text.is_upper(F.col("s")), text.quote_change(F.col("s")))) == [("a", False, 0)]


def _some(rng):
    level = lambda: rng.choice([None, None, "1", "1/A", "2", "10", "a", ("1", "2"), ("1/A", "10")])
    return C.Ref(rng.choice([None, "A", "B"]), *((v, v) if isinstance(v, str) else v for v in (level() for _ in range(4))))


def test_reference_algebra_equals_kernel(spark):
    rng = random.Random(7)
    pairs = [(_some(rng), _some(rng)) for _ in range(3000)]
    names = [f"{p}{c}" for p in "xy" for c in ("act", *(f"{lv}_{e}" for lv in refs.LEVELS for e in ("first", "last")))]
    flat = lambda r: (r.act, *(e for v in r[1:] for e in (v or (None, None))))
    df = spark.createDataFrame([(i, *flat(a), *flat(b)) for i, (a, b) in enumerate(pairs)], "i int, " + ", ".join(f"{n} string" for n in names))
    x, y = refs.of_columns("x"), refs.of_columns("y")
    step = df.select("i", refs.contains(x, y).alias("c"), refs.relative_to(x, y).alias("r"), refs.id_string(x).alias("s"), F.col("xact").alias("act"))
    back = step.withColumn("back", refs.from_id_string(F.col("s"), F.col("act")))
    got = back.select("i", "c", F.struct(*refs.flat(F.col("r"))).alias("r"), (refs.id_string(F.col("back")) == F.col("s")).alias("b")).orderBy("i").collect()
    for g, (a, b) in zip(got, pairs):
        assert g.c == C.contains(a, b), (a, b)
        assert tuple(g.r) == flat(C.relative_to(a, b)) and g.b


def test_reference_parts(spark):
    r = refs.ref(F.lit("A"), article=refs.level(F.lit("3:1/A")), paragraph=refs.level(F.lit("2"), F.lit("4")))
    got = spark.range(1).select(refs.id_string(r).alias("s"), refs.href(r).alias("h"), refs.is_range(r).alias("g"), refs.is_relative(r).alias("l"), refs.last_component(r).alias("k"), refs.id_string(refs.parent(r)).alias("p"), refs.id_string(refs.endpoint(r, "last")).alias("e"), refs.id_string(refs.make_range(refs.endpoint(r, "first"), refs.endpoint(r, "last"))).alias("m")).first()
    assert (got.s, got.h, got.g, got.l) == ("3colon1slashA_2-4__", "A.html#3colon1slashA_2-4__", True, False)
    assert tuple(got.k) == ("Paragraph", "2", "4") and got.p == "3colon1slashA___" and got.e == "3colon1slashA_4__" and got.m == got.s


def test_parts_of_lines(spark):
    line = [(10.0, "a", False), (5.0, "b", True), (9.0, "ffi", False), (15.0, "c", False)]
    df = spark.createDataFrame([(line, [1, 2, 1, 2, 1], ["x", "|", "y", "z", "|"], 0xF5, "Ő")], "p array<struct<dx:double,content:string,bold:boolean>>, l array<int>, s array<string>, n int, d string")
    parts = lambda c: [tuple(x) for x in c] if c is not None else None
    r = df.select(text.slice_line(F.col("p"), 1, 5).alias("a"), text.slice_line(F.col("p"), -1).alias("b"), text.slice_line(F.col("p"), 3).alias("c"), text.concat_lines(F.array(text.slice_line(F.col("p"), 0, 1), text.slice_line(F.col("p"), 5))).alias("d"), text.count_sublists(F.col("l"), F.array(F.lit(1), F.lit(2))).alias("e"), text.split_list(F.col("s"), F.lit("|")).alias("f"), text.latin2_char(F.col("n")).alias("g"), text.fix_glyph_case(F.col("d"), F.col("n")).alias("h")).first()
    assert parts(r.a) == [(15.0, "b", True), (9.0, "ffi", False)] and parts(r.b) == [(39.0, "c", False)] and r.c is None
    assert parts(r.d) == [(10.0, "a", False), (29.0, "c", False)] and r.e == 2 and r.f == [["x"], ["y", "z"], []] and (r.g, r.h) == ("ő", "ő")
