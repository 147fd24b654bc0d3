from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm.packing import Limits, pack, pack_block, pack_documents
from lexweave.llm.tokens import Tokenizer, encoding


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 50)), max_size=80), st.integers(1, 9), st.integers(20, 50))
def test_no_limit_is_exceeded(sizes, segments, loss_room):
    sizes = [(t, min(x, t, loss_room)) for t, x in sizes]
    tokens, loss = np.array([t for t, _ in sizes], np.int64), np.array([x for _, x in sizes], np.int64)
    container, slot = pack_block(tokens, loss, Limits(50, segments, loss_room))
    for c in set(container.tolist()):
        at = container == c
        assert tokens[at].sum() <= 50 and at.sum() <= segments and loss[at].sum() <= loss_room
        assert sorted(slot[at].tolist()) == list(range(at.sum()))
    assert len(container) == len(sizes)


def check(rows, limits, sizes):
    used, segments, parts = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in rows:
        used[r.container_id] += r.n_tokens
        segments[r.container_id] += 1
        parts[r.doc_id].append((r.start_token, r.n_tokens))
    assert all(0 < u <= limits.tokens for u in used.values()) and all(s <= limits.segments for s in segments.values())
    for doc, n in sizes.items():
        at = 0
        for start, k in sorted(parts.pop(doc, [])):
            assert start == at
            at += k
        assert at == max(0, n or 0)
        if 0 < (n or 0) <= limits.tokens:
            assert sum(r.doc_id == doc for r in rows) == 1
    assert not parts
    return len(used)


def test_defined_cases(spark):
    sizes = {1: None, 2: 0, 3: 1, 4: 2048, 5: 2049, 6: 10_000, 7: 1024, 8: 1024, 9: -3}
    df = spark.createDataFrame([(i, n, None, 5) for i, n in sizes.items()], "doc_id bigint, n_tokens int, loss_tokens int, slot int")
    check(pack(df).collect(), Limits(), sizes)
    assert pack(df.limit(0)).count() == 0


def test_loss_limit(spark):
    df = spark.createDataFrame([(i, 100, 40) for i in range(50)], "doc_id bigint, n_tokens int, loss_tokens int")
    rows = pack(df, Limits(1000, 64, 200)).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.container_id] += r.loss_tokens
    assert len(rows) == 50 and max(by.values()) <= 200 and len(by) == 10


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = {r.doc_id: len(encoding(Tokenizer()).encode_ordinary(r.text or "")) for r in df.collect()}
    n = check(pack_documents(df).collect(), Limits(), sizes)
    assert n <= -(-sum(sizes.values()) // 2048) * 1.1 + 1


def test_instruction_data(spark):
    from lexweave.llm.packing import pack_instructions
    from lexweave.llm.tokens import encoding as enc_of

    texts = [(i, f"Kérdés {i}\n" + "szó " * (5 + 37 * i % 300)) for i in range(120)] + [(7, "Csak kérdés"), (7, None), (8, ""), (9, "Kérdés\n" + "válasz " * 900)]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id bigint, text string, loss_tokens int")
    limits = Limits(600, 4, 400)
    rows = pack_instructions(df, limits).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.container_id].append(r)
    sums = [(sum(r.n_tokens for r in g), len(g), sum(r.loss_tokens for r in g)) for g in by.values()]
    assert all(t <= 600 and n <= 4 and x <= 400 for t, n, x in sums)
    # Each of the limits is what fills some container, and the prompts bear no loss.
    assert any(n == 4 and x < 350 for _, n, x in sums) and any(x > 390 and n < 4 for _, n, x in sums)
    enc = enc_of(Tokenizer())
    assert sum(r.n_tokens for r in rows) == sum(len(enc.encode_ordinary(t)) for _, t in texts if t)
    assert not any(r.loss_tokens for r in rows if r.doc_id == 7 and r.n_tokens < 6)
    assert pack_instructions(df.limit(0), limits).count() == 0
