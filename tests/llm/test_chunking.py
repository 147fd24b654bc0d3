import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm.chunking import assemble, boundaries, split, split_items

words = st.lists(st.sampled_from(["a", "törvény", "szerint,", "hatályos.", "A", "pl.", "12.", "§", "§;", "x" * 90, "\n", "é", "Az"]), min_size=0, max_size=200).map(" ".join)


def check(text, size, overlap, found):
    assert found[0].start_pos == 0 and found[-1].end_pos == len(text)
    assert all(0 < p.end_pos - p.start_pos <= size for p in found) or not text
    for a, b in zip(found, found[1:]):
        assert a.start_pos < b.start_pos <= a.end_pos < b.end_pos
        again = a.end_pos - b.start_pos
        assert again == b.overlap <= overlap
        if again < overlap:
            assert text[b.start_pos - 1].isspace()
            assert not any(text[p - 1].isspace() and not text[p].isspace() for p in range(a.end_pos - overlap, b.start_pos) if p > a.start_pos)
        end = a.end_pos
        if not text[end - 1].isspace() and a.boundary == 0:
            assert not any(c.isspace() for c in text[a.start_pos + a.overlap + 1 : min(a.start_pos + size, end)])


@settings(max_examples=200, deadline=None)
@given(words, st.integers(40, 200), st.integers(0, 20))
def test_pieces_cover_within_limit(text, size, overlap):
    check(text, size, overlap, split(text, size, overlap))


def test_boundaries_know_abbreviations():
    text = "A kút (pl. a tó) 2012. jan. 15-ig, az 5. § (2) bek. Szerint él. A másik."
    rank = boundaries(text)
    assert [text[p:] for p in range(len(text)) if rank[p] == 3] == ["A másik."]


def test_best_boundary_wins():
    intro, kids = "x " * 40, json.dumps([{"identifier": "a", "__type__": "AlphabeticSubpoint", "text": "y, z. Q " * 8}] * 6)
    body, starts = assemble(None, intro, kids, "w" * 10)
    found = split(body, 200, 20, starts)
    assert {p.boundary for p in found[:-1]} == {4} and {p.end_pos for p in found[:-1]} <= set(starts)


def test_edit_moves_only_neighbours():
    import random

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    body = [rng.choice(vocabulary) + rng.choice(["", "", ",", ";"]) for _ in range(4000)]
    cuts = lambda t: {t[p.end_pos - 60 : p.end_pos + 60] for p in split(t, 800, 80)}
    before = cuts(" ".join(body))
    after = cuts(" ".join([*body[:2000], "betoldott", "szavak", *body[2003:]]))
    assert len(before - after) <= 4 and len(before) > 30


def test_assembly():
    kids = json.dumps([{"__type__": "NumericSubpoint", "identifier": "1", "text": "egy"}, {"__type__": "AlphabeticSubpoint", "identifier": "b", "text": None}, {"identifier": None, "text": "három"}])
    assert assemble(None, "intro", kids, "") == ("intro 1. egy b)  három ", (6, 13, 17, 23))
    assert assemble("t", "intro", kids, "w")[0] == "t"
    assert assemble(None, None, "[{", None) == ("", ())


def test_defined_cases(spark):
    items = [(1, "P", "a" * 100, None, None, None), (2, "P", "a" * 101, None, None, None), (3, None, "a" * 500, None, None, None), (4, "Q", "a" * 500, None, None, None), (5, "P", None, None, None, None), (6, "P", "", None, "[]", None), (7, "P", None, "i " * 30, json.dumps([{"identifier": "a", "text": "szó " * 30}]), "vége"), (2, "P", "a" * 101, None, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in items], "row_id bigint, kind string, text string, intro string, children string, wrap_up string, piece string")
    limits = spark.createDataFrame([("P", 100, 10), ("R", 5, 1)], "kind string, max_chars int, overlap_chars int")
    got = split_items(df, limits).collect()
    assert {r.row_id for r in got} == {2, 7} and sum(r.row_id == 2 for r in got) == 4
    assert all(len(r.piece) <= 100 and len(r.piece) == r.end_pos - r.start_pos for r in got)
    assert split_items(df.limit(0), limits).count() == 0


def test_whole_table(spark, sf):
    items, limits = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("numeric_subpoints", "chunk_limits"))
    most = {r.kind: (r.max_chars, r.overlap_chars) for r in limits.collect()}
    bodies = {r.row_id: (assemble(r.text, r.intro, r.children, r.wrap_up)[0], *most[r.kind]) for r in items.collect()}
    by = {}
    for r in split_items(items, limits).collect():
        by.setdefault(r.row_id, []).append(r)
    assert set(by) == {k for k, (b, m, _) in bodies.items() if len(b) > m} and by
    for k, rows in by.items():
        rows.sort(key=lambda r: r.piece_no)
        body, size, overlap = bodies[k]
        assert "".join(r.piece[r.overlap :] for r in rows) == body
        assert max(len(r.piece) for r in rows) <= size and max(r.overlap for r in rows) <= overlap


def test_pieces_come_near_the_limit():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeő") for _ in range(rng.randint(2, 9))) for _ in range(4000))
    found = split(text, 400, 40)
    sizes = [p.end_pos - p.start_pos for p in found[:-1]]
    assert min(sizes) >= 0.6 * 400 and sum(sizes) / len(sizes) > 0.7 * 400


def test_edits_stay_local():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeő") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", ",", "."]) for _ in range(5000)]
    changed = []
    for _ in range(40):
        k = rng.randrange(len(words))
        a, b = (" ".join(w) for w in (words, [*words[:k], "új", *words[k:]]))
        old, new = ({t[p.start_pos : p.end_pos] for p in split(t, 400, 40)} for t in (a, b))
        changed.append(len(new - old))
    assert sum(changed) / len(changed) < 8 and len(old) > 60
