import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexweave.operators import elements as E
from lexweave.operators import fixups, gazette
from lexweave.operators import sentences as S
from lexweave.operators.groups import map_groups
from lexweave.operators.scans import previous, running_count, running_sum
from lexweave.operators.semantics import analyze_elements, children_types, to_analyze
from lexweave.operators import refs
from lexweave.plans import pipeline
from lexweave.plans.register import register
from lexweave.sinks import render
from lexweave.sources.lines import glyph_lines, html_texts, issue_index, text_lines
from lexweave.streaming.landing import not_done, run_landed

LINE = "act_id string, line_no int, content string"


def test_running_sum_over_blocks_equals_window(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).cast("int").alias("n"), F.when(F.col("id") % 7 > 0, F.hash("id") % 10).alias("v"))
    w = Window.partitionBy("k").orderBy("n")
    for inclusive in (True, False):
        got = running_sum(df, ["k"], "n", F.col("v"), "s", inclusive, block_rows=17)
        want = got.withColumn("w", F.coalesce(F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)), F.lit(0)))
        assert got.count() == 1000 and want.where("s <> w").count() == 0
    assert running_sum(df.limit(0), ["k"], "n", F.col("v"), "s").count() == 0


def test_running_count_over_blocks_equals_window(spark):
    df = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).cast("int").alias("n"))
    marks = df.where("n % 37 = 5 OR (k = 1 AND n > 150)").withColumn("m", F.lit("x"))
    got = running_count(df, ["k"], "n", marks, "c", block_rows=17)
    w = Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    assert got.count() == 600 and got.withColumn("w", F.count("m").over(w)).where("w <> c").count() == 0 and got.where("m = 'x'").count() == marks.count()


def test_previous(spark):
    df = spark.createDataFrame([(None, 0, "a"), (None, 1, "b"), ("x", 0, "c")], "k string, n int, v string")
    assert sorted((str(r.k), r.n, r.prev_v or "") for r in previous(df, ["k"], "n", ["v"]).collect()) == [("None", 0, ""), ("None", 1, "a"), ("x", 0, "")]


def test_groups_across_batches(spark):
    import pyarrow as pa

    df = spark.range(5000).select((F.col("id") % 40).alias("k"), F.col("id").alias("v"))
    out = map_groups(df, ["k"], ["v"], lambda g: [{"k": g[0]["k"], "n": len(g), "sorted": [x["v"] for x in g] == sorted(x["v"] for x in g)}], "k bigint, n bigint, sorted boolean", pa.schema([("k", pa.int64()), ("n", pa.int64()), ("sorted", pa.bool_())]), 7)
    assert sorted((r.k, r.n, r.sorted) for r in out.collect()) == [(k, 125, True) for k in range(40)]


def test_text_lines(spark):
    df = spark.createDataFrame([(1, "  a   b\r\n\n<BOLD>c<NJ>"), (2, ""), (3, None)], "doc_id int, text string")
    got = [(r.doc_id, r.line_no, r.content, r.indent, r.margin_right, r.bold, r.is_empty, [(g.at, g.width) for g in r.gaps]) for r in text_lines(df, "doc_id", "text").orderBy("doc_id", "line_no").collect()]
    assert got == [(1, 0, "a b", 20.0, 5.0, False, False, [(2, 10.0)]), (1, 1, "", 0.0, 0.0, False, True, []), (1, 2, "c", 40.0, 40.0, True, False, []), (2, 0, "", 0.0, 0.0, False, True, [])]


def test_glyph_lines(spark):
    box = lambda x, y, c, bold=False: ("i", 1, x, y, 5.0, 4.0, c, bold)
    boxes = [box(10.0, 700.0, "A", True), box(15.0, 700.1, "b", True), box(25.0, 700.0, "c"), box(30.0, 700.0, "„"), box(10.0, 690.0, "õ"), box(10.0, 650.0, "x"), box(10.0, 650.0, "x"), box(20.0, 650.0, " "), box(20.0, 650.0, "")]
    got = [(r.line_no, r.content, r.indent, r.bold) for r in glyph_lines(spark.createDataFrame(boxes, "issue_id string, page_no int, x double, y double, width double, width_of_space double, content string, bold boolean")).orderBy("line_no").collect()]
    assert got == [(0, "Ab c „", 10.0, False), (1, "ő", 10.0, False), (2, "", 0.0, False), (3, "x", 10.0, False)]


def test_html(spark):
    page = "<table><tr><td>2015. évi I. törvény</td><td>A kút&nbsp;rendje</td></tr><tr><td>más</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, ""), (3, None)], "id int, html string")
    assert [(r.tag, r.text) for r in html_texts(df, "id", "html").orderBy("pos").collect()] == [("td", "2015. évi I. törvény"), ("td", "A kút rendje"), ("td", "más")]
    assert [tuple(r) for r in issue_index(df, "id", "html").collect()] == [(1, "2015. évi I. törvény", "A kút rendje")]


def test_html_stack_and_runs(spark):
    from lexweave.sources.lines import glyph_conflicts, html_stack, until_missing

    df = spark.createDataFrame([(1, "<a><b>x<br>y</a>z</i><c>w"), (2, None)], "id int, html string")
    assert [("/".join(r.stack), r.text) for r in html_stack(df, "id", "html").orderBy("pos").collect()] == [("a/b", "x"), ("a/b", "y"), ("", "z"), ("c", "w")]
    found = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 4), ("b", 2), ("c", None)], "g string, n int")
    assert sorted(map(tuple, until_missing(found, "g", "n").collect())) == [("a", 1), ("a", 2)]
    boxes = spark.createDataFrame([("i", 1, 1.0, 1.0, "a"), ("i", 1, 1.0, 1.0, "b"), ("i", 1, 1.0, 2.0, "c"), ("i", 1, 1.0, 2.0, "c")], "issue_id string, page_no int, y double, x double, content string")
    assert [r.contents for r in glyph_conflicts(boxes).collect()] == [["a", "b"]]


def test_gazette(spark):
    rows = [("g", 1, i, c) for i, c in enumerate(["MAGYAR KÖZLÖNY", "", "x", "2011. június 28., kedd", "", "bevezető"])] + [("h", 1, 0, "más")]
    rows += [("g", 2, i, c) for i, c in enumerate(["fej", "", gazette.LAWS, "", "2011. évi IX. törvény", "a kútról", "szóló*", "1. § A.", "", "* jegyzet", "", "2. § B.", "", "X Y", "köztársasági elnök az Országgyűlés elnöke"])]
    rows += [("g", 3, i, c) for i, c in enumerate(["fej", "", "2011. évi XI. törvény", "a tóról*", "1. § C."])]
    df = spark.createDataFrame(rows, "issue_id string, page_no int, line_no int, content string")
    issues = gazette.gazettes(df)
    assert [(r.issue_id, str(r.publication_date)) for r in issues.collect()] == [("g", "2011-06-28")]
    acts = gazette.act_lines(gazette.section_lines(gazette.strip_headers(df)), issues).orderBy("act_id", "line_no").collect()
    assert [(r.act_id, r.subject, r.complete, r.content) for r in acts if r.complete] == [("2011. évi IX. törvény", "a kútról szóló", True, c) for c in ("1. § A.", "", "2. § B.")]
    assert {(r.act_id, r.complete) for r in acts if not r.complete} == {("2011. évi XI. törvény", False)}


def test_fixups(spark):
    lines = spark.createDataFrame([("A", i, c) for i, c in enumerate(["x", "y", "x", "z", "w"])] + [("B", 0, "y")], LINE)
    patches = spark.createDataFrame([("A", 1, "replace", "x", "X", ["x", "y"]), ("A", 2, "delete", "z", None, None), ("A", 3, "empty_after", "w", None, None), ("A", 4, "replace", "x", "!", None), ("B", 1, "delete", "q", None, None), ("C", 1, "delete", "q", None, None)], "act_id string, seq int, op string, needle string, replacement string, prev_lines array<string>")
    assert [(r.act_id, r.content) for r in fixups.apply_fixups(lines, patches).orderBy("act_id", "line_no", "sub_no").collect()] == [("A", "!"), ("A", "y"), ("A", "X"), ("A", "w"), ("A", ""), ("B", "y")]
    assert sorted(tuple(r) for r in fixups.failed_fixups(lines, patches).collect()) == [("B", 1, 0), ("C", 1, 0)]
    edited = spark.createDataFrame([("A", i, c) for i, c in enumerate(["x", "y", "X!", "", "w"])], LINE)
    made = fixups.make_fixups(lines, edited)
    assert sorted((r.op, r.needle, r.prev_lines) for r in made.collect()) == [("delete", "z", []), ("replace", "x", ["y"])]
    assert [r.content for r in fixups.apply_fixups(lines.where("act_id = 'A'"), made).orderBy("line_no").collect()] == ["x", "y", "X!", "w"]
    titled = spark.createDataFrame([("A", 0, "(A 3. §-hoz)"), ("A", 1, "2. § Szöveg"), ("A", 2, "tovább")], LINE)
    assert [r.content for r in fixups.bracketed_titles(titled).orderBy("line_no").collect()] == ["2. § [A 3. §-hoz]", "Szöveg", "tovább"]


PATCH = "act_id string, seq int, op string, needle string, replacement string, prev_lines array<string>"


def one_by_one(lines, patches):
    """The patches of one act, tried on all of its lines."""
    failed = []
    for _, seq, op, needle, new, context in sorted(patches, key=lambda x: x[1]):
        context = context or []
        at = [i for i, c in enumerate(lines) if c == needle and (not context or (i >= len(context) and lines[i - len(context) : i] == context))]
        if len(at) != 1:
            failed.append((seq, len(at)))
            continue
        i = at[0]
        lines = lines[: i + 1] + [""] + lines[i + 1 :] if op == "empty_after" else lines[:i] + lines[i + 1 :] if op == "delete" or not new else lines[:i] + [new] + lines[i + 1 :]
    return lines, failed


def test_patches_in_order(spark):
    import random

    acts = {
        "twice": (["a", "b"], [("empty_after", "a", None, None), ("replace", "a", "A", None)]),
        "chain": (["x", "y", "z"], [("replace", "x", "x1", None), ("replace", "x1", "x2", None), ("replace", "y", "Y", ["x2"]), ("delete", "z", None, ["x2", "Y"])]),
        "many": (["k"] * 30 + ["l"], [("delete", "k", None, None), ("replace", "l", "L", ["k", "k"]), ("replace", "k", "K", ["L"])]),
        "nothing": ([], [("delete", "q", None, None)]),
    }
    rng = random.Random(6)
    for n in range(40):
        lines = [rng.choice(["a", "b", "c", "", "d"]) for _ in range(rng.randint(1, 25))]
        acts[f"r{n}"] = (lines, [(rng.choice(["replace", "delete", "empty_after"]), rng.choice(["a", "b", "c", "", "X"]), rng.choice(["X", "a", "", None]), [rng.choice(["a", "b", "X", "", "d"]) for _ in range(rng.randint(0, 2))]) for _ in range(rng.randint(1, 5))])
    lines = spark.createDataFrame([(k, i, c) for k, (ls, _) in acts.items() for i, c in enumerate(ls)], LINE)
    rows = {k: [(k, i, *x) for i, x in enumerate(ps, 1)] for k, (_, ps) in acts.items()}
    patches = spark.createDataFrame([r for x in rows.values() for r in x], PATCH)
    got, failed = {k: [] for k in acts}, {k: [] for k in acts}
    for r in fixups.apply_fixups(lines, patches).orderBy("act_id", "line_no", "sub_no").collect():
        got[r.act_id].append(r.content)
    for r in fixups.failed_fixups(lines, patches).collect():
        failed[r.act_id].append((r.seq, r.hits))
    for k, (ls, _) in acts.items():
        want, bad = one_by_one(ls, rows[k])
        assert got[k] == want and sorted(failed[k]) == bad, k
    assert got["chain"] == ["x2", "Y"] and got["twice"] == ["A", "", "b"]
    assert fixups.apply_fixups(lines, patches.limit(0)).count() == lines.count() and fixups.failed_fixups(lines.limit(0), patches).count() == patches.count()


ACT = """Bevezető

1. §   (1) A kútra a Vgt. (a szabály) 2. § (1) bekezdése szerint:
       a) az 5. § c) pontja, és
       b) más
       irányadó.
       (2) Jó.
2. §   „nincs vége
3. §   A Vgt. 4. §-a helyébe a következő rendelkezés lép: (ha igen)
       „4. § (1) Egy.
       (2) Kettő.”
       (akkor)"""


def _elements(spark):
    df = spark.createDataFrame([("X", ACT.replace("„nincs", "nincs")), ("Y", ACT), ("Z", "csak bevezető"), ("W", "")], "act_id string, text string")
    return E.parse_acts(text_lines(df, "act_id", "text").withColumnRenamed("doc_id", "act_id")).cache()


def test_elements_amendments_and_errors(spark):
    e = _elements(spark)
    x = {r.element_id: r for r in e.where("act_id = 'X'").collect()}
    assert x["1_1__"].wrap_up == "irányadó." and x["1_1_a_"].text == "az 5. § c) pontja, és" and x["2_0__"].text == "nincs vége" and x["preamble"].text == "Bevezető"
    # An open quote takes the rest of the act into the article that opens it, and that article alone is in error.
    y = {r.element_id: r.error for r in e.where("act_id = 'Y'").collect()}
    assert [k for k, v in y.items() if v] == ["error-2"] and "1_1_b_" in y
    assert [(r.kind, r.text) for r in e.where("act_id = 'Z'").collect()] == [("Preamble", "csak bevezető")] and e.where("act_id = 'W'").count() == 0
    opened = [(r.element_id, r.kind, r.intro, r.wrap_up, r.text) for r in E.open_amendments(e.where("act_id = 'X'")).orderBy("path").collect()]
    assert opened == [("3_0__.amendment", "BlockAmendmentContainer", "ha igen", "akkor", None), ("3_0__.amendment/4___", "Article", None, None, None), ("3_0__.amendment/4_1__", "Paragraph", None, None, "Egy."), ("3_0__.amendment/4_2__", "Paragraph", None, None, "Kettő.")]


def test_context_and_citations(spark):
    e = E.with_context(_elements(spark).where("act_id = 'X'"))
    a = e.where("element_id = '1_1_a_'").first()
    assert a.sentence == "A kútra a Vgt. (a szabály) 2. § (1) bekezdése szerint: az 5. § c) pontja irányadó."
    found = S.citations(S.analyze_sentences(e, ["element_id", "prefix"], "sentence"), ["element_id", "prefix"])
    got = {(r.element_id, r.start_pos - len(r.prefix), r.article_first, r.point_first) for r in found.where("element_id = '1_1_a_' AND end_pos > length(prefix)").collect()}
    assert got == {("1_1_a_", 3, "5", "c")}


def test_tree_operators(spark):
    e = _elements(spark).where("act_id = 'X'")
    upper = E.map_elements(e, lambda d: {"text": F.upper("text")}, F.col("kind") == "AlphabeticPoint")
    assert sorted(r.text for r in upper.where("depth = 2 AND text IS NOT NULL").collect()) == ["AZ 5. § C) PONTJA, ÉS", "MÁS"]
    roots = e.where("element_id = '1_1__'").select("act_id", F.col("element_id").alias("root_id"), F.col("path").alias("root_path"))
    assert sorted(r.element_id for r in E.subtree(e, roots).collect()) == ["1_1__", "1_1_a_", "1_1_b_"]
    ranges = spark.createDataFrame([("r", "X", "1___", "1", "2")], "range_id string, act_id string, parent_id string, first string, last string")
    assert sorted(r.element_id for r in E.cut_by_identifier(e, ranges).collect()) == ["1_1__", "1_2__"]
    assert E.invariants(e).count() == 0
    broken = e.withColumn("intro", F.when(F.col("element_id") == "1_2__", F.lit("x")).otherwise(F.col("intro")))
    assert [tuple(r) for r in E.invariants(broken).collect()] == [("X", "1_2__", "text beside intro or wrap-up")]


def test_renderings(spark):
    e = _elements(spark).where("act_id = 'X'")
    txt = render.txt(e, 40).first().txt
    assert "1. §" in txt and txt.index("a)   ") < txt.index("irányadó.") < txt.index("(2)  Jó.") and "„" in txt
    links = spark.createDataFrame([("X", "1_1_a_", 3, 17, "#5__c_"), ("X", "1_1_a_", 5, 9, "#overlap")], "act_id string, element_id string, start_pos int, end_pos int, href string")
    html = render.html(e, links).first().html
    assert 'az <a href="#5__c_">5. § c) pontja</a>, és' in html and "overlap" not in html and 'id="1_1_a_"' in html
    import json

    tree = json.loads(render.nested_json(e).first().json)
    assert [t["__type__"] for t in tree] == ["Preamble", "Article", "Article", "Article"] and tree[1]["children"][0]["children"][1]["text"] == "más"
    heads = spark.createDataFrame([("Book", "3", None), ("Part", "2", True), ("Part", "2", False), ("Title", "9", None), ("Chapter", "4/A", None), ("Subtitle", "17", None), ("Subtitle", "", None)], "k string, i string, s boolean")
    assert [r[0] for r in heads.select(render.formatted_heading(F.col("k"), F.col("i"), F.col("s"))).collect()] == ["HARMADIK KÖNYV", "KÜLÖNÖS RÉSZ", "MÁSODIK RÉSZ", "IX. CÍM", "IV/A. FEJEZET", "17.", ""]
    wrapped = spark.range(1).select(render.wrap(F.lit("aa bb cccccc d"), 5).alias("w")).first().w
    assert wrapped == ["aa bb", "cccccc", "d"]


def test_abbreviations_as_of(spark):
    d = spark.createDataFrame([("A", "V.", 1, "x"), ("A", "V.", 5, "y"), ("A", "V.", 5, "y"), ("B", "V.", 1, "z")], "act_id string, abbreviation string, n int, act string")
    u = spark.createDataFrame([("A", "V.", 0), ("A", "V.", 1), ("A", "V.", 4), ("A", "V.", 5), ("A", "W.", 5), ("C", "V.", 9)], "act_id string, abbreviation string, n int")
    assert sorted((r.act_id, r.abbreviation, r.n, r.target_act) for r in S.resolve_abbreviations(u, d, "n").collect()) == [("A", "V.", 0, None), ("A", "V.", 1, "x"), ("A", "V.", 4, "x"), ("A", "V.", 5, "y"), ("A", "W.", 5, None), ("C", "V.", 9, None)]


def test_sentences_defined_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "semmi"), (4, "§" * 10_001), (5, "Ez a törvény 2014. február 31-én lép hatályba."), (6, "A 3. §."), (6, "A 3. §.")], "id int, text string").withColumn("act", F.lit(1))
    found = S.analyze_sentences(df, ["id"], "text")
    assert [(r.id, r.date_kind, r.exact_date) for r in S.records(found, ["id"], "EnforcementDate").collect()] == [(5, "Date", None)]
    assert [r.id for r in S.citations(found, ["id"]).collect()] == [6, 6]


def test_landing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, v string")
    assert sorted(r.v for r in not_done(df, df.where("id = 1"), "id").collect()) == ["b", "c"]
    df.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        run_landed(spark, f"{tmp_path}/in", "id int, v string", lambda b: b.withColumn("u", F.upper("v")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert sorted(r.u for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["A", "B", "C"]


def test_semantics_in_context(spark):
    rows = [
        ("A", "1", None, [1], None, "A vízről szóló 2001. évi V. törvény (a továbbiakban: Vgt.) szerint:", "irányadó."), ("A", "1a", "1", [1, 1], "a Vgt. 2. §-a, és", None, None),
        ("A", "2", None, [2], "Az új 2002. évi X. törvény (a továbbiakban: Vgt.) él.", None, None), ("A", "3", None, [3], "A Vgt. 9. §-a.", None, None), ("B", "1", None, [1], "A Vgt. 9. §-a.", None, None),
    ]
    e = spark.createDataFrame(rows, "act_id string, element_id string, parent_id string, path array<int>, text string, intro string, wrap_up string").withColumn("in_amendment", F.lit(None).cast("boolean"))
    got = analyze_elements(e)
    cited = {(r.act_id, r.element_id, r.start_pos, r.end_pos, r.act, r.article_first) for r in got.citations.collect()}
    assert ("A", "1a", 7, 13, "2001. évi V. törvény", "2") in cited and ("A", "3", 7, 13, "2002. évi X. törvény", "9") in cited and ("B", "1", 7, 13, "Vgt.", "9") in cited
    assert {(r.element_id, r.act) for r in got.abbreviations.collect()} == {("1", "2001. évi V. törvény"), ("1a", "2001. évi V. törvény"), ("2", "2002. évi X. törvény")}
    done = e.where("element_id <> '3'")
    assert [r.element_id for r in to_analyze(e, done).collect()] == ["3"]
    assert sorted(r.element_id for r in to_analyze(e, done, spark.createDataFrame([("B",)], "act_id string")).collect()) == ["1", "3"]
    assert [tuple(r) for r in children_types(e.withColumn("kind", F.lit("P"))).collect()] == [("A", "1", 1, "P")]


def test_pipeline(spark, tmp_path):
    head = ["MAGYAR KÖZLÖNY", "", "x", "2011. június 28., kedd", "", "bevezető"]
    body = ["fej", "", gazette.LAWS, "", "2011. évi IX. törvény", "a kútról*", "1. § Hibás sor.", "2. § A Vgt. 4. §-a helyébe a következő rendelkezés lép:", "„4. § Új.”", "", "X Y", "köztársasági elnök az Országgyűlés elnöke"]
    df = spark.createDataFrame([("g", p, i, c) for p, page in ((1, head), (2, body)) for i, c in enumerate(page)], "issue_id string, page_no int, line_no int, content string")
    raw = pipeline.raw_acts(df, "2011. évi IX. törvény")
    assert raw.count() == 3 and pipeline.raw_acts(df, "más").count() == 0
    patches = spark.createDataFrame([("2011. évi IX. törvény", 1, "replace", "1. § Hibás sor.", "1. § Jó sor.", None), ("2011. évi IX. törvény", 2, "empty_after", "„4. § Új.”", None, None)], "act_id string, seq int, op string, needle string, replacement string, prev_lines array<string>")
    e = pipeline.open_blocks(pipeline.structure(raw, patches))
    rows = {r.element_id: (r.kind, r.text) for r in e.collect()}
    assert rows["1_0__"] == ("Paragraph", "Jó sor.") and rows["2_0__.amendment/4_0__"] == ("Paragraph", "Új.") and not any(k == "QuotedBlock" for k, _ in rows.values())
    for fmt in pipeline.FORMATS:
        pipeline.write(e, fmt, f"{tmp_path}/{fmt}")
        assert "Jó sor." in "".join(r.value for r in spark.read.text(f"{tmp_path}/{fmt}").collect())


def test_in_sql(spark):
    register(spark)
    register(spark)
    one = spark.sql("SELECT lex_roman(1998) a, lex_ordinal('Huszonegyedik') b, lex_month('május') c, lex_month('x') d, lex_quote_change('„a') e, lex_natural_key('12/A') f, lex_roman(0) g").first()
    assert (one.a, one.b, one.c, one.d, one.e, [tuple(x) for x in one.f], one.g) == ("MCMXCVIII", 21, 5, None, 1, [("", 12), ("/A", -1)], None)
    spark.createDataFrame([(1, "A Vgt. 3. §-a."), (2, None), (3, "semmi")], "id int, text string").createOrReplaceTempView("lex_t")
    assert [tuple(r) for r in spark.sql("SELECT t.id, c.act, c.article_first FROM lex_t t, LATERAL lex_analyze(t.text) c WHERE c.what = 'Citation' ORDER BY c.seq").collect()] == [(1, "Vgt.", None), (1, "Vgt.", "3")]


def test_at_reference(spark):
    e = spark.createDataFrame([("A", x) for x in ("1___", "1_0__", "1_0_a_", "1_0_b_", "2___", "2_1__", "2_1a__", "2_2__", "2_10__", "book-1")] + [("B", "1___")], "act_id string, element_id string")
    lv = refs.level
    r = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit("p").alias("ref_id"), refs.ref(F.lit("A"), article=lv(F.lit("1")), point=lv(F.lit("b"))).alias("reference")),
        F.struct(F.lit("q").alias("ref_id"), refs.ref(F.lit("A"), article=lv(F.lit("2")), paragraph=lv(F.lit("1a"), F.lit("9"))).alias("reference")),
        F.struct(F.lit("r").alias("ref_id"), refs.ref(F.lit("A"), article=lv(F.lit("9"))).alias("reference")),
    )).alias("x")).select("x.*")
    assert sorted(tuple(x) for x in E.at_reference(e, r).collect()) == [("p", "A", "1_0_b_"), ("q", "A", "2_1a__"), ("q", "A", "2_2__")]


GAZETTE = {
    1: ["MAGYAR KÖZLÖNY", "1. szám", "", "2013. március 15., péntek", "", "Tartalomjegyzék", "valami"],
    2: ["12", "fejléc", "II. Törvények", "", "2013. évi I. törvény", "Egy tárgyról*", "1. §   A vízről szóló 2010. évi X. törvény (a továbbiakban: Vgt.) irányadó.", "2. §   (1) A Vgt. 3. §-a szerint:", "       a) ez,", "       b) az.", "3. §   A Vgt. 4. §-a helyébe a következő rendelkezés lép:", "       „4. § Új.”", "", "A, B", "köztársasági elnök az Országgyűlés elnöke"],
    3: ["13", "fejléc", "", "2013. évi II. törvény", "Más*", "1. §   Ez a törvény 2014. január 1-jén lép hatályba.", "", "A, B", "köztársasági elnök az Országgyűlés alelnöke"],
}


def _gazette(spark):
    return spark.createDataFrame([("i1", p, n, c) for p, lines in GAZETTE.items() for n, c in enumerate(lines)], "issue_id string, page_no int, line_no int, content string")


def test_pipeline_by_steps(spark, tmp_path):
    from lexweave.plans import pipeline
    from lexweave.sinks.render import read_semantics

    lines = _gazette(spark)
    raw = pipeline.run(lines, "raw_act")
    assert {(r.act_id, str(r.publication_date), r.subject, r.complete) for r in raw.acts.collect()} == {("2013. évi I. törvény", "2013-03-15", "Egy tárgyról", True), ("2013. évi II. törvény", "2013-03-15", "Más", True)} and raw.elements is None
    kinds = lambda r: sorted(x.kind for x in r.elements.collect())
    assert "QuotedBlock" in kinds(pipeline.run(lines, "structure_only")) and "BlockAmendmentContainer" in kinds(pipeline.run(lines, "ba_only"))
    issue_of = spark.createDataFrame([("2013. évi I. törvény", "i1"), ("x", "i2")], "act_id string, issue_id string")
    one = pipeline.run(lines, single_act="2013. évi I. törvény", issue_of=issue_of, modifiers=[lambda e: e.where("kind <> 'Preamble'")])
    assert {r.act_id for r in one.elements.collect()} == {"2013. évi I. törvény"}
    assert pipeline.run(lines, "structure_only", single_act="nincs").elements.count() == 0
    try:
        pipeline.run(lines, "más")
        raise AssertionError
    except ValueError:
        pass
    pipeline.write(one.elements, "json", str(tmp_path / "json"), one.semantics, acts_per_file=False)
    found = read_semantics(spark.read.parquet(str(tmp_path / "json")))
    what = {}
    for r in found.collect():
        what.setdefault((r.node_path, r.what), []).append(json.loads(r.data))
    assert [x["abbreviation"] for x in what["r.1.1", "act_id_abbreviations"]] == ["Vgt."]
    # The short name is resolved to the act it was given to.
    assert all(x["act"] == "2010. évi X. törvény" for x in what["r.2.1", "outgoing_references"]) and what["r.3.1", "semantic_data"][0]["what"] == "BlockAmendment"
    pipeline.write(one.elements, "txt", str(tmp_path / "txt"))
    assert [r.act_id for r in spark.read.text(str(tmp_path / "txt")).select("act_id").distinct().collect()] == ["2013. évi I. törvény"]


def test_context_of_any_depth_and_circles(spark):
    rows = [("A", str(i), str(i - 1) if i else None, f"i{i}", None) for i in range(12)] + [("A", "leaf", "11", None, "t"), ("A", "x", "y", "ix", None), ("A", "y", "x", "iy", None), ("B", "leaf", "11", None, "t")]
    df = spark.createDataFrame([(*r, None) for r in rows], "act_id string, element_id string, parent_id string, intro string, text string, wrap_up string")
    got = {(r.act_id, r.element_id): r.sentence for r in E.with_context(df).collect()}
    assert len(got) == len(rows) and got["A", "leaf"] == " ".join(f"i{i}" for i in range(12)) + " t." and got["B", "leaf"] == "t." and got["A", "x"] == "iy ix."
    assert E.with_context(df.limit(0)).count() == 0


def test_documents_in_parts(spark):
    df = spark.createDataFrame([("A", "x")], "act_id string, text string")
    e = E.parse_acts(text_lines(df.select("act_id", F.lit("\n".join(f"{i}. §   (1) Szöveg {i}." for i in range(1, 41))).alias("text")), "act_id", "text").withColumnRenamed("doc_id", "act_id"))
    whole = render.txt(e).collect()
    parts = sorted(render.txt(e, part_chars=200).collect(), key=lambda r: r.part)
    assert len(whole) == 1 and len(parts) > 3 and "\n".join(p.txt for p in parts) == whole[0].txt and max(len(p.txt) for p in parts) < 300
    pages = sorted(render.html(e, part_chars=400).collect(), key=lambda r: r.part)
    assert "".join(p.html for p in pages) == render.html(e).first().html and pages[0].html.startswith("<!DOCTYPE") and pages[-1].html.endswith("</html>")
    assert sum((json.loads(r.json) for r in sorted(render.nested_json(e, 300).collect(), key=lambda r: r.part)), []) == json.loads(render.nested_json(e).first().json)


def test_subtree_by_prefixes(spark):
    e = _elements(spark)
    roots = e.where("element_id = '1_1__'").select("act_id", F.col("element_id").alias("root_id"), F.col("path").alias("root_path"))
    got = {(r.act_id, r.element_id) for r in E.subtree(e, roots).collect()}
    want = {(r.act_id, r.element_id) for r in e.collect() for x in roots.collect() if x.act_id == r.act_id and r.path[: len(x.root_path)] == x.root_path}
    assert got == want and got


def test_folder_of_intermediate_tables(spark):
    from types import SimpleNamespace

    from lexweave.session import shared_checkpoint_dir

    cluster = SimpleNamespace(master="spark://x:7077", getConf=lambda: SimpleNamespace(get=lambda *_: None), getCheckpointDir=lambda: None)
    try:
        shared_checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=cluster))
        raise AssertionError
    except ValueError:
        pass


def test_command_line(spark, tmp_path):
    from lexweave import cli

    _gazette(spark).write.parquet(str(tmp_path / "lines"))
    cli.main([str(tmp_path / "lines"), str(tmp_path / "out"), "--single-act", "2013. évi II. törvény", "--step", "structure_only", "--format", "json", "--many-acts-a-file"])
    got = spark.read.parquet(str(tmp_path / "out" / "json")).collect()
    assert [r.act_id for r in got] == ["2013. évi II. törvény"] and json.loads(got[0].json)[0]["identifier"] == "1"
    cli.main([str(tmp_path / "lines"), str(tmp_path / "out"), "--step", "raw_act"])
    assert spark.read.parquet(str(tmp_path / "out" / "acts")).select("act_id").distinct().count() == 2


def test_registry_of_patches_and_functions(spark):
    lines = spark.createDataFrame([("A", 0, "x"), ("A", 1, "y"), ("B", 0, "x")], LINE)
    r = fixups.Registry()
    r.add("A", "replace", "x", "X")
    r.add("A", "empty_after", "X")
    r.call("A", lambda df: df.withColumn("content", F.upper("content")))
    r.call("C", lambda df: df)
    assert [(x.act_id, x.content) for x in r.apply(lines).orderBy("act_id", "line_no").collect()] == [("A", "X"), ("A", ""), ("A", "Y"), ("B", "x")]
    assert fixups.Registry().apply(lines).count() == 3


def test_trees_rewritten(spark):
    e = _elements(spark)
    same = lambda a, b: {tuple(map(str, r)) for r in a.collect()} == {tuple(map(str, r)) for r in b.select(a.columns).collect()}
    assert same(E.map_trees(e, lambda n: n), e) and same(E.map_trees(e, lambda n: n, children_first=True), e)

    def change(n):
        if n["element_id"] == "1_1_a_":
            return None
        if n["element_id"] == "1_2__":
            return [n, {"element_id": "1_3__", "kind": "Paragraph", "identifier": "3", "text": "Új.", "in_amendment": False}]
        return n | {"children": n["children"][::-1]} if n["kind"] == "Article" else n

    got = {r.element_id: r for r in E.map_trees(e.where("act_id = 'X'"), change).collect()}
    assert "1_1_a_" not in got and got["1_1_b_"].ord == 1 and got["1_1_b_"].path == [1, 3, 1] and got["1_3__"].path == [1, 2] and got["1_3__"].parent_id == "1___" and got["1_2__"].ord == 1
    counted = {r.element_id: r.text for r in E.map_trees(e.where("act_id = 'X'"), lambda n: n | {"text": str(len(n["children"]))}, children_first=True).collect()}
    assert counted["1___"] == "2" and counted["1_1__"] == "2"
    assert E.map_trees(e.limit(0), change).count() == 0
