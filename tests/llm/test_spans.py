import random
from collections import defaultdict

import numpy as np
import pytest

from lexweave.llm.spans import Hasher, longest_shared, shared_shares, shared_spans


def brute(rows, n):
    """Spans by comparing every window of every body."""
    where = defaultdict(set)
    bodies = {(a, e, t if t is not None else i) for a, e, t, i in rows}
    for a, e, b in bodies:
        for k in range(len(b or "") - n + 1):
            where[b[k : k + n]].add((a, e))
    out = set()
    for a, e, b in bodies:
        flags = [False] * (len(b or "") + 1)
        for k in range(len(b or "") - n + 1):
            if len(where[b[k : k + n]]) > 1:
                flags[k : k + n] = [True] * n
        start = None
        for k, x in enumerate(flags):
            if x and start is None:
                start = k
            if not x and start is not None:
                out.add((a, e, start, k))
                start = None
    return out


def test_window_hashes():
    text = "abcabcabcé👍abc"
    h = Hasher(text).windows(3)
    assert len(h) == len(text) - 2 and h[0] == h[3] == h[6] == h[11] and len(np.unique(h)) == len({text[i : i + 3] for i in range(len(text) - 2)})


@pytest.mark.parametrize("seed,n", [(1, 12), (2, 13), (3, 21)])
def test_against_every_window(spark, seed, n):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abé ") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = []
    for i in range(150):
        b = "".join(rng.choice(stock)[rng.randint(0, 4) : rng.randint(6, 60)] if rng.random() < 0.6 else "".join(rng.choice("xyzű") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 6)))
        rows.append((f"A{i % 7}", f"e{i // 3}", b if i % 4 else None, b if i % 5 else None))
    rows += rows[:20] + [("A", "1", "x" * 50, None), ("A", "1", "x" * 50, None), ("B", "1", "aa" * 40, None), ("B", "2", "aa" * 40, None), (None, "1", "q" * 40, None), ("C", None, "q" * 41, None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "act_id string, element_id string, text string, intro string, body_id int, body string")
    got = [tuple(r)[:4] for r in shared_spans(df, n).collect()]
    assert set(got) == brute(rows, n) and len(got) == len(set(got)) > 10


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/btk_mod_1.parquet")
    rows = [(r.act_id, r.element_id, r.text, r.intro) for r in df.collect()]
    assert {tuple(r)[:4] for r in shared_spans(df).collect()} == brute([r for r in rows if r[2] or r[3]], 120)
    assert all(0 < r.share <= 1 for r in shared_shares(df).collect())
    assert shared_spans(df.limit(0)).count() == 0


def brute_longest(rows, n):
    out, length = {}, n
    while found := brute(rows, length):
        out |= {(a, e): length for a, e, _, _ in found}
        length *= 2
    return out


def test_longest_by_doubling(spark, sf):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdé ") for _ in range(700))
    rows = [("A", "1", long[:500], None), ("A", "2", "x" + long[100:330], None), ("A", "3", long[250:299] + "yz", None), ("B", "1", "q" * 100, None), ("B", "2", "q" * 100, None), ("B", "3", None, long[400:]), ("B", "4", None, None)]
    df = spark.createDataFrame(rows, "act_id string, element_id string, text string, intro string")
    got = {(r.act_id, r.element_id): r.shared_length for r in longest_shared(df, 20).collect()}
    assert got == brute_longest([r for r in rows if r[2] or r[3]], 20) and got["A", "1"] == 160 and got["A", "3"] == 40 and got["B", "1"] == 80
    assert longest_shared(df.limit(0), 20).count() == 0
    table = spark.read.parquet(f"{sf}/btk_mod_1.parquet")
    assert {(r.act_id, r.element_id): r.shared_length for r in longest_shared(table).collect()} == brute_longest([(r.act_id, r.element_id, r.text, r.intro) for r in table.collect() if r.text or r.intro], 120)
