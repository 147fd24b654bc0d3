import pytest

from lexweave.kernels.citations import Ref, Structural, analyze, contains, interesting, relative_to
from lexweave.kernels.identifiers import natural_key, next_identifier
from lexweave.kernels.numerals import ORDINALS, from_roman, ordinal, roman_to_arabic, to_roman
from lexweave.kernels.structure import Line, StructureError, act, amendment_block, article, flatten, quote_levels


def r(act=None, article=None, paragraph=None, point=None, subpoint=None):
    pair = lambda v: v if v is None or isinstance(v, tuple) else (v, v)
    return Ref(act, *map(pair, (article, paragraph, point, subpoint)))


def cited(text):
    return [(text[c.start : c.end], c.ref) for c in analyze(text).citations]


def test_roman_round_trip():
    assert all(from_roman(to_roman(n)) == n for n in range(1, 4000))
    assert from_roman("IIII") == 4 and roman_to_arabic("VI/A") == "6/A"
    with pytest.raises(ValueError):
        from_roman("ABC")


def test_ordinals():
    assert len(ORDINALS) == 100 and ordinal("HUSZONEGYEDIK") == 21 and ordinal("századik") == 100


@pytest.mark.parametrize("kind,a,b", [("Article", "1", "2"), ("Article", "1", "1/A"), ("Article", "1/A", "1/B"), ("Article", "1/A", "2"), ("Article", "2:9", "3:1"), ("Paragraph", "1a", "1b"), ("AlphabeticPoint", "g", "gy"), ("AlphabeticPoint", "g", "h"), ("AlphabeticPoint", "ny", "o"), ("AlphabeticSubpoint", "ba", "bb"), ("AlphabeticSubpoint", "a", "b"), ("NumericPoint", "3", "3/a")])
def test_successors(kind, a, b):
    assert next_identifier(kind, a, b) and not next_identifier(kind, b, a)


@pytest.mark.parametrize("kind,a,b", [("Article", "1", "3"), ("Article", "2:9", "4:1"), ("Article", "2:9", "3:2"), ("Paragraph", "1", "1b"), ("AlphabeticPoint", "a", "c"), ("AlphabeticSubpoint", "ba", "cb"), ("Paragraph", "x", "y")])
def test_no_successors(kind, a, b):
    assert not next_identifier(kind, a, b)


def test_natural_order():
    ids = ["10", "a", "2a", "1/A", "2"]
    assert sorted(ids, key=natural_key) == ["1/A", "2", "2a", "10", "a"]


def test_joined_and_separate_lists():
    assert cited("A Vgt. 4. § (1), (2) és (5)–(7) bekezdése.") == [("Vgt.", r("Vgt.")), ("4. § (1), (2)", r("Vgt.", "4", ("1", "2"))), ("(5)–(7) bekezdése", r("Vgt.", "4", ("5", "7")))]
    assert cited("A 7. § a), b), c) pontja.") == [("7. § a), b)", r(None, "7", None, ("a", "b"))), ("c) pontja", r(None, "7", None, "c"))]


def test_deep_reference_and_book():
    assert cited("Az eljárás a 3:12/A. § (2) bekezdés b) pont ba) alpontja szerint.") == [("3:12/A. § (2) bekezdés b) pont ba) alpontja", r(None, "3:12/A", "2", "b", "ba"))]
    assert cited("A Vgt. 4. § k) pont 2. alpontja.")[1][1] == r("Vgt.", "4", None, "k", "2")


def test_quotes_are_not_scanned():
    assert cited("A Vgt. „a 3. § (1) bekezdése” szöveg, és a 4. §.") == [("Vgt.", r("Vgt.")), ("4. §", r(None, "4"))]


def test_act_by_number_with_short_name():
    a = analyze("A vízről szóló 1995. évi LVII. törvény (a továbbiakban: Vgtv.) 2. §-a helyébe a következő rendelkezés lép:")
    assert [(x.abbreviation, x.act) for x in a.abbreviations] == [("Vgtv.", "1995. évi LVII. törvény")]
    assert a.records[0].ref == r("1995. évi LVII. törvény", "2") and not a.records[0].pure_insertion
    assert not analyze("A vízről szóló 1995. évi LVII. törvény (a továbbiakban: 1995. évi LVII. törvény) 2. §-a.").abbreviations


def test_amendment_and_insertion_make_a_range_unless_inside():
    both = "A Vgt. 5. § {} bekezdése helyébe a következő rendelkezés lép, és a § a következő {} bekezdéssel egészül ki:"
    assert analyze(both.format("(3)", "(4)")).records[0].ref == r("Vgt.", "5", ("3", "4"))
    assert analyze(both.format("(3)–(5)", "(3a)")).records[0].ref == r("Vgt.", "5", ("3", "5"))


@pytest.mark.parametrize("text,where,new", [
    ("A Vgt. a 30. §-t megelőzően a következő alcímmel egészül ki:", Structural("Vgt.", position="BEFORE_WITHOUT_ARTICLE", article="30"), True),
    ("A Vgt. a 30. §-t követően a következő alcímmel egészül ki:", Structural("Vgt.", position="AFTER", article="30"), True),
    ("A Vgt. 30. §-a és az azt megelőző alcím helyébe a következő alcím és rendelkezés lép:", Structural("Vgt.", position="BEFORE_WITH_ARTICLE", article="30"), False),
    ("A Vgt. Második Könyv Harmadik Része helyébe a következő rész lép:", Structural("Vgt.", book="2", part="3"), False),
    ("A Vgt. Második Könyve a következő IX. Címmel egészül ki:", Structural("Vgt.", book="2", title="9"), True),
    ("A Vgt. a következő IV/B. Fejezettel egészül ki:", Structural("Vgt.", chapter="4/B"), True),
    ("A Vgt. „Vizek védelme” című alcíme helyébe a következő rendelkezés lép:", Structural("Vgt.", subtitle="Vizek védelme"), False),
])
def test_headings(text, where, new):
    record = analyze(text).records[0]
    assert record.structural == where and record.pure_insertion == new and not analyze(text).citations


def test_title_of_an_act_is_skipped():
    text = "A kútról szóló 2013. évi V. törvény hatálybalépésével összefüggő szabályokról szóló 2014. évi VI. törvény 3. §-a helyébe a következő rendelkezés lép:"
    assert analyze(text).records[0].ref == r("2014. évi VI. törvény", "3")


def test_enforcement():
    when = lambda t: [(x.date_kind, x.date, x.days, x.day, x.months, x.repeal_date, x.ref) for x in analyze(t).records]
    assert when("Ez a törvény a kihirdetését követő napon lép hatályba.") == [("DaysAfterPublication", None, 1, None, None, None, None)]
    assert when("E törvény a kihirdetését követő nyolcadik napon lép hatályba.")[0][2] == 8
    assert when("A 3. § a kihirdetést követő hónap ötödik napján lép hatályba.") == [("DayInMonthAfterPublication", None, None, 5, 1, None, r(None, "3"))]
    assert when("Ez a törvény 2014. május 2-án lép hatályba, és e törvény 2015. június 3-án hatályát veszti.") == [("Date", (2014, 5, 2), None, None, None, (2015, 6, 3), None)]
    inherited = [x[-1] for x in when("A 3. § (1) bekezdés a) pontja, (2) bekezdése és a 9. § 2014. május 2-án lép hatályba.")]
    assert inherited == [r(None, "3", "1", "a"), r(None, "3", "2"), r(None, "9")]
    but = analyze("Ez a törvény – a (2) bekezdésben foglalt kivétellel – 2014. május 2-án lép hatályba.")
    assert len(but.records) == 1 and [c.ref for c in but.citations] == [r(None, None, "2")]


def test_texts_with_nested_quotes():
    a = analyze("A Vgt. 2. §-ában az „egy „kettő” három” szövegrész helyébe a „négy” szöveg, az „öt” szövegrész helyett a „hat” szöveg lép.")
    assert [(x.original, x.replacement) for x in a.records] == [("egy „kettő” három", "négy"), ("öt", "hat")]


def test_repeal_of_wordings():
    a = analyze("Hatályát veszti a Vgt. 2. § a) és c) pontjában az „egy”, valamint a „kettő” szövegrész.")
    assert [(x.ref, x.original) for x in a.records] == [(r("Vgt.", "2", None, p), t) for p in "ac" for t in ("egy", "kettő")]


def test_uninteresting():
    assert not interesting("Semmi különös.") and not interesting("§" * 10_001) and interesting("3. §")
    assert analyze("").citations == () and analyze("„ nyitott idézet 3. § ").records == ()


def test_relative_and_containment():
    base = r("A", "1", "2", "a")
    assert relative_to(r(None, None, "5"), base) == r("A", "1", "5") and relative_to(r("B"), base) == r("B") and relative_to(Ref(), base) == base
    inside = [(r("A", "1"), r("A", "1", "2")), (r("A", ("1", "3")), r("A", "2/A", "9")), (r("A", "1", ("1", "3")), r("A", "1", "2", "b")), (r("A"), r("A", "7")), (r("A", ("1", "3")), r("A", ("1", "2")))]
    outside = [(r("A", "1", "2"), r("A", "1")), (r("A", ("1", "3")), r("A", "10")), (r("A", "1"), r("B", "1")), (r("A", ("2", "3")), r("A", ("1", "2")))]
    assert all(contains(*x) for x in inside) and not any(contains(*x) for x in outside)


def lines(text):
    out = []
    for raw in text.split("\n"):
        bold, ragged = "<BOLD>" in raw, "<NJ>" in raw
        raw = raw.replace("<BOLD>", "      ").replace("<NJ>", "    ")
        stripped, at, gaps, more = raw.strip(), 0, [], 0
        for w in stripped.split(" "):
            if not w:
                more += 1
                continue
            if more:
                gaps.append((at, more * 5.0))
            at, more = at + len(w) + 1, 0
        out.append(Line(" ".join(stripped.split()), 5 * (len(raw) - len(raw.lstrip()) + 2), 40.0 if ragged else 5.0, bold, tuple(gaps)) if stripped else Line(""))
    return out


def test_structure_of_an_act():
    text = """Bevezető szöveg-
sel.

MÁSODIK RÉSZ
Itt nem fogadható el

ELSŐ RÉSZ
A RÉSZ CÍME

<BOLD>1. Alcím

1. §   (1) Az alábbiak:
       a) egy;
       b) kettő:
          ba) alma,
          bb) körte,
       és ennyi.
       (2) Nem pont: b) kettő.
       (4) Nem következik.
1/A. § [A cím
       folytatása]
       Szöveg egyetlen bekezdéssel.
2. §   A Vgt. 3. § helyébe a következő rendelkezés lép:
       „3. § Új „belső” szöveg.
       (2) Idézett.”
KÜLÖNÖS RÉSZ"""
    preamble, found = act(lines(text))
    rows = {x["element_id"]: x for x in flatten(found)}
    assert preamble.startswith("Bevezető szöveg-sel. MÁSODIK RÉSZ")
    assert [x["kind"] for x in found] == ["Part", "Subtitle", "Article", "Article", "Article", "Part"]
    assert found[0]["title"] == "A RÉSZ CÍME" and found[1]["identifier"] == "1" and found[1]["title"] == "Alcím" and found[-1]["special"]
    assert rows["1_1__"]["intro"] == "Az alábbiak:" and rows["1_1__"]["wrap_up"] == "és ennyi."
    assert rows["1_1_b_bb"]["text"] == "körte," and rows["1_2__"]["text"] == "Nem pont: b) kettő. (4) Nem következik."
    assert rows["1slashA___"]["title"] == "A cím folytatása" and rows["1slashA_0__"]["text"] == "Szöveg egyetlen bekezdéssel."
    quoted = rows["2_0__.quotedblock-1"]["lines"]
    assert [x.content for x in quoted] == ["3. § Új „belső” szöveg.", "(2) Idézett."]


def test_one_item_is_no_list():
    rows = flatten([article(lines("1. § Az alábbi:\n     a) egyedül"))])
    assert rows[-1]["text"] == "Az alábbi: a) egyedül" and len(rows) == 2


def test_ragged_line_ends_the_last_item():
    found = amendment_block(lines("(2) Ha:\na) egy, vagy\nb) kettő,<NJ>\nakkor három."), "Paragraph", "2")
    assert [c["text"] for c in found[0]["children"]] == ["egy, vagy", "kettő,"] and found[0]["wrap_up"] == "akkor három."


def test_blocks_of_an_amendment():
    two = amendment_block(lines("3. § Egy.\n4. § Kettő.\n9. § Nem új."), "Article", "3")
    assert [x["identifier"] for x in two] == ["3", "4"] and two[1]["children"][0]["text"] == "Kettő. 9. § Nem új."
    sub = amendment_block(lines("bc) Egy;\nbd) kettő."), "AlphabeticSubpoint", "bc")
    assert [(x["identifier"], x["text"]) for x in sub] == [("bc", "Egy;"), ("bd", "kettő.")]


def test_unbalanced_quotes():
    for bad in ("„a", "a”", "„a” b”"):
        with pytest.raises(StructureError):
            quote_levels(lines(bad))
    with pytest.raises(StructureError):
        article(lines("1. § [a\nb\nc\nd]"))


def test_every_kind_of_heading_and_point():
    text = """ELSŐ KÖNYV
BEVEZETŐ RENDELKEZÉSEK

ELSŐ RÉSZ
ÁLTALÁNOS SZABÁLYOK

I. CÍM
AZ ELSŐ CÍM

I. FEJEZET
AZ ELSŐ FEJEZET

<BOLD>1. Első alcím

1:1. § (1) Számozott pontok:
       1. egy:
       a) alap,
       b) bér;
       2. kettő.
       (2) Betűs pontok:
       a) első:
       aa) fa,
       ab) fű;
       b) második:
       1. szám,
       2. másik szám;
       c) harmadik.

<BOLD>1/A. Közbülső alcím

1:2. § Szöveg.

II. FEJEZET
A MÁSODIK FEJEZET

IIII. FEJEZET

MÁSODIK KÖNYV
A MÁSODIK KÖNYV CÍME

I. CÍM
ÚJRA ELSŐ

2:1. § Vége."""
    _, found = act(lines(text))
    tops = [(x["kind"], x["identifier"]) for x in found]
    assert tops == [("Book", "1"), ("Part", "1"), ("Title", "1"), ("Chapter", "1"), ("Subtitle", "1"), ("Article", "1:1"), ("Subtitle", "1/A"), ("Article", "1:2"), ("Chapter", "2"), ("Book", "2"), ("Title", "1"), ("Article", "2:1")]
    assert [x["title"] for x in found if x["kind"] in ("Book", "Title")] == ["BEVEZETŐ RENDELKEZÉSEK", "AZ ELSŐ CÍM", "A MÁSODIK KÖNYV CÍME", "ÚJRA ELSŐ"]
    rows = {x["element_id"]: x for x in flatten(found)}
    kinds = {k: rows[k]["kind"] for k in ("1colon1_1_1_", "1colon1_1_1_a", "1colon1_2_a_ab", "1colon1_2_b_2")}
    assert kinds == {"1colon1_1_1_": "NumericPoint", "1colon1_1_1_a": "AlphabeticSubpoint", "1colon1_2_a_ab": "AlphabeticSubpoint", "1colon1_2_b_2": "NumericSubpoint"}
    assert rows["1colon1_1_1_a"]["text"] == "alap," and rows["1colon1_2_a_ab"]["text"] == "fű;" and rows["1colon1_2_b_2"]["text"] == "másik szám;" and rows["1colon2_0__"]["text"] == "Szöveg."
