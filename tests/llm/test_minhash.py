import random

import numpy as np
import pytest

from sleuthgrid.llm.common import Workspace
from sleuthgrid.llm.components import connected
from sleuthgrid.llm.hashing import mix
from sleuthgrid.llm.minhash import near_duplicates, signature


def jaccard(a, b):
    def sh(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    x, y = sh(a), sh(b)
    return len(x & y) / max(1, len(x | y))


@pytest.mark.parametrize("weighted", [False, True])
def test_signature_estimates_likeness(weighted):
    rng = np.random.default_rng(1)
    ids = mix(np.arange(1, 1500, dtype=np.uint64))
    a, b = ids[:1000], ids[250:1250]
    wa = rng.choice([0.5, 1.0, 3.5, 9.0], 1500) if weighted else np.ones(1500)
    k = 2000
    sa = signature(a, wa[:1000] if weighted else None, k)
    sb = signature(b, wa[250:1250] if weighted else None, k)
    true = wa[250:1000].sum() / wa[:1250].sum()
    assert abs((sa == sb).mean() - true) < 0.05
    assert (signature(a[:1], None, 130) == signature(a[:1], None, 130)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 105), (105, 103), (7, 7)]
    got = connected(Workspace(spark, "t"), spark.createDataFrame(edges, "x long, y long"), "c").collect()
    assert {r.id: r.comp for r in got} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 105: 100}


def test_groups_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(60, 200))]
        for c in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
    rows += [rows[0], rows[0], "", None, "one two", "one two", "one two three"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    assert sorted(got) == list(range(len(rows)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i] or "", rows[j] or ""
            if a == b or jaccard(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert {i: got[i].group_id for i in got} == {i: find(i) for i in got}
    assert near_duplicates(df.limit(0)).count() == 0


def test_counts_as_weights(spark):
    line = " ".join(f"a{i}" for i in range(30))
    other = " ".join(f"b{i}" for i in range(30))
    rows = [(1, f"{line} {other}"), (2, f"{line} " * 20 + other), (3, f"{line} " * 19 + other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: r.group_id for r in near_duplicates(df).collect()}
    weighted = {r.doc_id: r.group_id for r in near_duplicates(df, counts=True).collect()}
    assert plain[2] == plain[3] and weighted == {1: 1, 2: 2, 3: 2}


def test_recall_against_all_rows(spark):
    """Texts whose id is divisible by 20 against all rows of a table."""
    from sleuthgrid.llm.minhash import likeness, shingles

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.group_key for r in near_duplicates(docs).collect()}
    rows = {r.doc_id: shingles((r.text or "").encode()) for r in docs.select("doc_id", "text").collect()}
    links = [(i, j) for i in rows if i % 20 == 0 for j in rows if i != j and likeness(rows[i], rows[j], False) >= 0.8]
    assert len(links) > 5 and all(got[i] == got[j] for i, j in links)


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "w1 w2")], "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
