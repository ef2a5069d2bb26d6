"""Topic trees and Ward's clusters against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sleuthgrid.operators import topics as tp
from sleuthgrid.operators import ward
from sleuthgrid.operators.steps import Rounds


def rows_of(rng, n, groups):
    out = []
    for i in range(n):
        terms = Counter(rng.choice([f"g{i % groups}t{rng.randrange(4)}", f"common{rng.randrange(3)}"]) for _ in range(12))
        norm = math.sqrt(sum(x * x for x in terms.values()))
        out += [(i, t, x / norm) for t, x in terms.items()]
    return out


def test_k_means_is_a_fixed_point_and_by_seed(spark):
    rng = random.Random(2)
    rows = rows_of(rng, 60, 4)
    weights = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    members = spark.createDataFrame([("p" if i < 40 else "q", i, 4) for i in range(60)] + [("q", 99, 4)], "path string, doc_id long, k int")
    got = {(r["path"], r["doc_id"]): r["j"] for r in tp.k_means(Rounds(spark), members, weights, 42).collect()}
    assert got == {(r["path"], r["doc_id"]): r["j"] for r in tp.k_means(Rounds(spark), members.repartition(3), weights.repartition(5), 42).collect()}
    assert got["q", 99] == 0 and len(got) == 61
    vec = {}
    for i, t, x in rows:
        vec.setdefault(i, {})[t] = x
    for path in "pq":
        centre = {}
        for j in range(tp.PARTS):
            total = Counter()
            for (p, i), k in got.items():
                if p == path and k == j:
                    total.update(vec.get(i, {}))
            norm = math.sqrt(sum(x * x for x in total.values()))
            centre[j] = {t: x / norm for t, x in total.items()} if norm else {}
        for (p, i), j in got.items():
            if p == path and i in vec:
                sims = [round(sum(x * centre[c].get(t, 0) for t, x in vec[i].items()), 9) for c in range(tp.PARTS)]
                assert sims[j] == max(sims)


def test_tree_holds_every_document_once_a_level(spark):
    rng = random.Random(3)
    weights = spark.createDataFrame(rows_of(rng, 30, 3), "doc_id long, term string, weight double")
    docs = spark.createDataFrame([(i,) for i in range(31)], "doc_id long")
    got = tp.topic_tree(docs, weights).collect()
    leaves = [r["doc_id"] for r in got if r["leaf"]]
    assert sorted(leaves) == list(range(31))
    at = {}
    for r in got:
        at.setdefault((r["depth"], r["path"]), set()).add(r["doc_id"])
    assert at[0, ""] == set(range(31))
    for (depth, path), docs_ in at.items():
        kids = [(p, s) for (d, p), s in at.items() if d == depth + 1 and p.rpartition("-")[0] == path]
        if kids:
            assert set().union(*[s for _, s in kids]) == docs_ and sum(len(s) for _, s in kids) == len(docs_)
            assert sorted(p.rpartition("-")[2] for p, _ in kids) == [str(i) for i in range(len(kids))] and 2 <= len(kids) <= max(2, min(5, len(docs_) // 2))
    same = weights.filter("doc_id = 0").drop("doc_id").crossJoin(spark.range(5).withColumnRenamed("id", "doc_id")).select("doc_id", "term", "weight")
    assert {(r["depth"], r["leaf"]) for r in tp.topic_tree(spark.range(5).withColumnRenamed("id", "doc_id"), same).collect()} == {(0, True)}


def test_labels(spark):
    tokens = {1: ["red", "fox", "red", "fox", "runs"], 2: ["red", "fox", "jumps"], 3: ["red", "dog"], 4: ["blue"], 5: []}
    weights = [(1, "red", 0.8), (1, "fox", 0.6), (2, "red", 0.5), (2, "fox", 0.5), (2, "jumps", 0.7), (3, "red", 0.6), (3, "dog", 0.8), (4, "blue", 1.0)]
    members = [("a", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5)]
    got = {r["path"]: (r["label"], r["keywords"]) for r in tp.labels(spark.createDataFrame(members, "path string, doc_id long"), spark.createDataFrame(weights, "doc_id long, term string, weight double"), spark.createDataFrame(list(tokens.items()), "doc_id long, tokens array<string>")).collect()}
    assert got == {"a": ("red / fox", ["red", "fox", "red fox", "fox red", "fox runs", "dog", "jumps"]), "b": ("blue", ["blue"]), "c": ("cluster", [])}


def brute_ward(x):
    clusters = {i: (x[i], 1) for i in range(len(x))}
    out = []
    while len(clusters) > 1:
        d, a, b = min((2 * na * nb / (na + nb) * float(((ca - cb) ** 2).sum()), a, b) for a, (ca, na) in clusters.items() for b, (cb, nb) in clusters.items() if a < b)
        (ca, na), (cb, nb) = clusters.pop(a), clusters.pop(b)
        clusters[a] = ((ca * na + cb * nb) / (na + nb), na + nb)
        out.append((a, b, math.sqrt(d), na + nb))
    return out


@pytest.mark.parametrize("block", [2000, 13])
def test_ward_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ward, "BLOCK", block)
    x = np.random.default_rng(1).normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0])], "id long, vector array<double>")
    tree = ward.merges(df)
    want = brute_ward(x)
    got = sorted((r["height"], r["a"], r["b"], r["n"]) for r in tree.collect())
    assert [g[1:] for g in got] == [(a, b, n) for a, b, _, n in want]
    assert [g[0] for g in got] == pytest.approx([h for *_, h, _ in want])
    whole = df.filter(F.col("id") < 1000)
    cuts = {}
    for r in ward.cut_at(whole, tree, [1, 2, 5, 12, 60]).collect():
        cuts.setdefault(r["k"], {})[r["id"]] = r["cluster"]
    for k, found in cuts.items():
        label = {i: i for i in range(60)}
        for a, b, *_ in want[: 60 - k]:
            label = {i: a if c == b else c for i, c in label.items()}
        assert found == label and len(set(found.values())) == k


def test_equal_vectors_and_few(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(7)] + [(9, [5.0, 5.0])], "id long, vector array<double>")
    tree = ward.merges(df)
    assert sorted(r["height"] for r in tree.collect())[:6] == [0.0] * 6 and tree.count() == 7
    two = {r["id"]: r["cluster"] for r in ward.cut_at(df, tree, [2]).collect()}
    assert two == dict.fromkeys(range(7), 0) | {9: 9}
    assert ward.merges(df.filter("id = 9")).count() == 0 and ward.merges(df.filter("id < 0")).count() == 0
    assert ward.level_counts(500, "detailed") == [30] * 6 and ward.level_counts(10, "medium") == [9, 5, 3, 2]


@pytest.mark.parametrize("last", [1, 7, 12_000])
def test_ward_in_rounds_and_in_one_task(spark, monkeypatch, last):
    """With ties and with vectors far from 0, whose products lose what tells them apart."""
    monkeypatch.setattr(ward, "BLOCK", 13)
    monkeypatch.setattr(ward, "LAST", last)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(25, 3)), 1e8 + rng.integers(0, 40, size=(12, 3)).astype(float)])
    tree = ward.merges(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>"))
    got = sorted((r["height"], r["a"], r["b"], r["n"]) for r in tree.collect())
    want = brute_ward(x)
    assert len(got) == 36 and {g[1:] for g in got} == {(a, b, n) for a, b, _, n in want}
    assert [g[0] for g in got] == pytest.approx(sorted(h for *_, h, _ in want))


def test_nearest_in_seconds():
    """6,000 vectors against 6,000: products, and differences only for what can be the nearest."""
    import time

    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(5990, 64)), np.ones((10, 64))])
    ids = np.arange(6000)
    start = time.process_time()
    other, d = ward._closest(ids, x, np.ones(6000), ids, x, np.ones(6000))
    assert time.process_time() - start < 20
    for i in [*range(0, 5990, 400), *range(5990, 6000)]:
        far = ((x - x[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        assert other[i] == far.argmin() and d[i] == far.min()


def test_trees_by_tasks_and_by_levels(spark, monkeypatch):
    """The tree is the same whether clusters are parted by a task each, by levels, or first by levels and then by tasks."""
    rng = random.Random(12)
    weights = spark.createDataFrame(rows_of(rng, 40, 5), "doc_id long, term string, weight double")
    docs = spark.createDataFrame([(i,) for i in range(42)], "doc_id long")
    ids = spark.range(-3, 40).withColumn("h", F.xxhash64("id", F.lit("1-0-4-2-1-3"), F.lit(42))).collect()
    assert tp._hashed(np.array([r["id"] for r in ids]), "1-0-4-2-1-3", 42).tolist() == [r["h"] for r in ids]
    found = []
    for whole in (tp.WHOLE, 150):
        monkeypatch.setattr(tp, "WHOLE", whole)
        found.append(sorted(map(tuple, tp.topic_tree(docs, weights).select("path", "depth", "doc_id", "leaf").collect())))
    assert found[0] == found[1] and max(r[1] for r in found[0]) > 2
