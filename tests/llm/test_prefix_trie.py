"""The trie of rebuilt conversations against a brute-force one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sleuthgrid.llm import prefix_trie
from sleuthgrid.llm.common import Workspace
from sleuthgrid.llm.ranking import dense_names, ranked

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()}


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("name", F.lit("clash")).withColumn("rep", F.lit(3)).repartition(3)
    got = [tuple(r[c] for c in COLUMNS) for r in prefix_trie.query(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 60), -3, -5, -7, 1001, 1003, 2**40 + 1]:
        if c % 11 == 4:
            continue  # some bases are absent
        for t in range(rng.choice([1, 2, 3, 7, 8, 9, 20])):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "é", None, "", "x" * 50])))
    rows += rows[:20] + [(None, 1, "user", "nobody's"), (5, 99, "user", "very long " * 50_000)]
    assert run(spark, rows) == brute(rows)


def test_one_turn_for_all_and_none(spark):
    rows = [(c, t, "user", "the same" if t == 0 else f"{c % 7}") for c in range(300) for t in range(2)]
    assert run(spark, rows) == brute(rows)
    only = [(c, 0, "user", "hello") for c in range(100, 140)]
    assert run(spark, only) == brute(only)
    assert run(spark, [(7, 0, "user", "x")]) == brute([(7, 0, "user", "x")])
    assert run(spark, []) == set()


def test_long_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rows = [(c, t, "user", str(t if c < 20 or t < 9 else t + c)) for c in range(40) for t in range(5 + c % 30)]
    assert run(spark, rows) == brute(rows)


def test_ranks_of_a_hot_key(spark):
    ws = Workspace(spark, "test-ranks")
    rows = [(1, i % 50) for i in range(900)] + [(k, k) for k in range(2, 60)]
    df = ws.write(spark.createDataFrame(rows, "k long, v long").repartition(7), "rows")
    got = ranked(ws, df, "k", ["v"], "out").collect()
    for k in {r["k"] for r in got}:
        mine = sorted((r["rank"], r["v"]) for r in got if r["k"] == k)
        assert [r for r, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted(v for _, v in mine)
    names = dense_names(ws, df, ["k"], "names").collect()
    assert sorted(r["name"] for r in names) == list(range(len(names))) and sum(r["n"] for r in names) == len(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 16])
def test_every_length(spark, n):
    rows = [(c, t, "user", str(t)) for c in (10, 15) for t in range(n)]
    assert run(spark, rows) == brute(rows)
