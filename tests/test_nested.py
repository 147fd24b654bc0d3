import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.kernels.nested import label, link
from lexweave.operators.nested import flatten_nested, link_tables, node_table


def brute(children):
    """Plain recursion over the record, without labels."""

    class Bad(Exception):
        pass

    def level(v):
        if isinstance(v, str):
            if not v.strip():
                return []
            try:
                return level(json.loads(v))
            except ValueError:
                raise Bad from None
        if isinstance(v, dict):
            return [v]
        if isinstance(v, list):
            return [o for x in v for o in level(x)]
        return []

    def walk(v, path):
        for i, o in enumerate(level(v), 1):
            p = f"{path}.{i}"
            ident = o.get("identifier")
            ident = "" if ident is None else ident if isinstance(ident, str) else json.dumps(ident)
            yield p, path, o.get("__type__") or "Paragraph", ident
            yield from walk(o.get("children"), p)

    try:
        return list(walk(children, "r"))
    except Bad:
        return []


def kernel(children):
    nodes = label(children)
    return [(path, above, n.kind, n.identifier) for n, (path, above, _, _) in zip(nodes, link(nodes))]


elements = st.recursive(
    st.fixed_dictionaries({}, optional={"__type__": st.sampled_from(["Paragraph", "AlphabeticPoint", None]), "identifier": st.one_of(st.none(), st.integers(0, 9), st.text(max_size=2)), "text": st.text(max_size=4)}),
    lambda inner: st.builds(lambda o, c, how: o | {"children": c if how == 0 else json.dumps(c) if how == 1 else (c or [None])[0]}, st.fixed_dictionaries({}, optional={"identifier": st.text(max_size=2)}), st.lists(st.one_of(st.none(), inner), max_size=3), st.integers(0, 2)),
    max_leaves=12,
)


@settings(max_examples=150, deadline=None)
@given(st.lists(elements, max_size=4))
def test_labels_equal_plain_recursion(tree):
    text = json.dumps(tree)
    assert kernel(text) == brute(text)


def test_intervals_nest():
    nodes = label('[{"children":[{"children":{"identifier":3}},{}]},{}]')
    for a in nodes:
        for b in nodes:
            assert a.post < b.pre or b.post < a.pre or (a.pre <= b.pre and b.post <= a.post) or (b.pre <= a.pre and a.post <= b.post)


def test_defined_cases(spark):
    deep = "[" + '{"children":[' * 400 + "{}" + "]}" * 400 + "]"
    rows = [
        (1, None), (2, ""), (3, "[]"), (4, '[{"identifier": "1"'), (5, '[null, {"identifier": 7}, 3]'), (6, '"[{\\"identifier\\": null}]"'),
        (7, '[{"children": "[{"}]'), (8, deep), (9, '[{"semantic_data": {"__type__": "Repeal"}}]'), (5, '[null, {"identifier": 7}, 3]'),
    ]
    df = spark.createDataFrame([(i, c, "x", "y") for i, c in rows], "record_id bigint, children string, node_path string, kind string")
    got = sorted((r.record_id, r.node_path, r.parent_path, r.kind, r.identifier) for r in flatten_nested(df).collect() if r.record_id != 8)
    assert got == [(5, "r.1", "r", "Paragraph", "7")] * 2 + [(6, "r.1", "r", "Paragraph", ""), (9, "r.1", "r", "Paragraph", "")]
    assert flatten_nested(df.where("record_id = 8")).count() == 401
    assert flatten_nested(df.limit(0)).count() == 0


def test_tables_by_containment(spark):
    df = spark.createDataFrame([(1, '[{"__type__":"P","children":[{"__type__":"Q","children":[{"__type__":"S"}]},{"__type__":"S"}]},{"__type__":"S"}]')], "record_id bigint, children string")
    nodes = flatten_nested(df)
    near = link_tables(node_table(nodes, "P"), node_table(nodes, "S")).collect()
    far = link_tables(node_table(nodes, "P"), node_table(nodes, "S"), any_depth=True).collect()
    assert [r.node_path for r in near] == ["r.1.2"] and sorted(r.node_path for r in far) == ["r.1.1.1", "r.1.2"]


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/ambigous_points.parquet")
    want = sorted((r.record_id, *x) for r in df.collect() for x in brute(r.children))
    got = sorted((r.record_id, r.node_path, r.parent_path, r.kind, r.identifier) for r in flatten_nested(df).collect())
    assert got == want and got
