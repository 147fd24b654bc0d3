import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm.tokens import Tokenizer, concatenate, encode_corpus, encode_leaf, encoding, leaves

TOK = Tokenizer()


def tree(text, leaf):
    return concatenate(((x.run, encode_leaf(x.text, x.run)) for x in leaves(text, leaf_chars=leaf)))


pieces = st.sampled_from(["törvény", " ", "  ", "\n", "\n\n", "\t", "a", "'s", "'", "ll", "<|endoftext|>", "1234", "§", "…", " ", "é", "é", "👍", "aaaa", ".", "-" * 9, " x"])


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=40), st.integers(1, 12))
def test_tree_equals_encoding_in_one_piece(parts, leaf):
    text = "".join(parts)
    assert "".join(x.text for x in leaves(text, leaf_chars=leaf)) == text
    assert tree(text, leaf) == encoding(TOK).encode_ordinary(text)


@pytest.mark.parametrize("seed", range(6))
def test_long_unsplit_runs(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("abétörvny" if seed % 2 else "ab") for _ in range(20_000)) + " " * 3000 + "x" * 5000 + "".join(rng.choice("0123456789") for _ in range(3000))
    assert tree(text, 512) == encoding(TOK).encode_ordinary(text)


def test_corpus_defined_cases(spark):
    long = "szó " * 9000 + "y" * 20_000
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a <|endoftext|> b"), (5, long), (6, long), (7, "törvény"), (7, "törvény")]
    df = spark.createDataFrame([(i, t, [9], "z") for i, t in rows], "doc_id bigint, text string, ids array<int>, seq string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_corpus(df).collect())
    assert got == sorted((i, encoding(TOK).encode_ordinary(t) if t else []) for i, t in rows)
    assert encode_corpus(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: encoding(TOK).encode_ordinary(r.text or "") for r in df.collect()}
    assert {r.doc_id: list(r.ids) for r in encode_corpus(df, long_chars=500, leaf_chars=100).collect()} == want


def test_long_texts_of_one_id_and_counts(spark):
    from lexweave.llm.tokens import count_tokens

    rows = [(1, "szó " * 9000), (1, "y" * 30_000), (1, "y" * 30_000), (1, "rövid"), (2, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted((i, encoding(TOK).encode_ordinary(t) if t else []) for i, t in rows)
    assert sorted((r.doc_id, list(r.ids)) for r in encode_corpus(df).collect()) == want
    assert sorted((r.doc_id, r.n_tokens) for r in count_tokens(df).collect()) == sorted((i, len(x)) for i, x in want)
