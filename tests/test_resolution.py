"""Candidates against all pairs, and merges of a batch."""

import random

import pytest

from sleuthgrid.operators import graph
from sleuthgrid.operators import resolution as rs


@pytest.mark.parametrize("threshold", [0.92, 0.85])
def test_no_pair_over_the_threshold_is_lost(spark, threshold):
    rng = random.Random(5)
    names = {"".join(rng.choice("abcdé 1") for _ in range(rng.randrange(1, 12))) for _ in range(150)}
    for n in list(names)[:100]:  # near copies: swaps, losses, gains
        c = list(n)
        i = rng.randrange(len(c))
        c[i:i] = rng.choice([[], ["x"]])
        j = min(i + 1, len(c) - 1)
        c[i], c[j] = c[j], c[i]
        names.add("".join(c))
    names |= {"jon x", "jno x", "abcd", "acbd", "a", "ab", "ba", "", "the long name of something", "teh long name of something"}
    df = spark.createDataFrame([(n,) for n in names], "low string")
    got = {tuple(r) for r in rs.candidates(df, df.withColumnRenamed("low", "other"), threshold, words=False).collect()}
    want = {(a, b) for a in names for b in names if rs.jaro_winkler(a, b) >= threshold}
    assert want <= got
    assert len(got) < len(names) ** 2 / 2


def test_words_of_names(spark):
    names = ["Putin", "Vladimir Putin", "St. Petersburg", "Petersburg", "Peters", "a-b corp", "b corp"]
    low = spark.createDataFrame([(n.lower(),) for n in names], "low string")
    got = {tuple(r) for r in rs.candidates(low, low.withColumnRenamed("low", "other"), 0.92).collect()}
    assert {("putin", "vladimir putin"), ("st. petersburg", "petersburg"), ("b corp", "a-b corp")} <= got


def test_pairs_without_three_characters_in_common(spark):
    existing = spark.createDataFrame([("jno x", "Person", 0), ("acbd", "Person", 1)], "name string, entity_type string, position int")
    asked = spark.createDataFrame([("jon x", "Person"), ("abcd", "Person")], "name string, entity_type string")
    assert {(r["name"], r["match"], r["rule"]) for r in rs.resolve(asked, existing).collect()} == {("jon x", "jno x", "fuzzy"), ("abcd", "acbd", "fuzzy")}


def test_batch_merge(spark):
    batch = [
        (1, "Acme Corporation", "Organization", False, False), (2, "ACME corporation ", "Organization", False, False), (3, "Acme Corporatoin", "Organization", False, False),
        (4, "2024", "Date", False, True), (5, "soon", "Date", False, False), (6, "Sign in", "Organization", True, False), (7, "Putin", "Person", False, False),
        (8, "evil.com", "Domain", False, False), (9, "evil.con", "Domain", False, False), (10, "Acme Corporation", "Organization", False, False), (11, None, "Person", True, False), (12, "Nowhere", None, False, False),
    ]
    graph_ = spark.createDataFrame([("Vladimir Putin", "Person", 0, "g0"), ("evil.com", "Domain", 1, "g1"), ("Vladimir Putin", "Person", 2, "g2")], "name string, entity_type string, position int, id string")
    rows = spark.createDataFrame(batch, "position int, name string, entity_type string, filtered boolean, absorbed boolean").repartition(3)
    merged = rs.merge_batch(rows, graph_)
    got = {r["position"]: (r["outcome"], r["entity"]) for r in merged.collect()}
    assert got == {1: ("created", "new:1"), 2: ("merged", "new:1"), 3: ("merged", "new:1"), 4: ("absorbed", None), 5: ("orphaned", None), 6: ("filtered", None), 7: ("merged", "g0"), 8: ("merged", "g1"), 9: ("created", "new:9"), 10: ("merged", "new:1"), 11: ("filtered", None), 12: ("created", "new:12")}
    assert rs.counters(merged).head().asDict() == {"created": 3, "merged": 5, "filtered": 2, "absorbed": 1, "orphaned": 1}
    edges = [("Acme Corporation", "Putin", "USES", 0.2), ("Acme Corporation", "2024", "OCCURRED_ON", 0.9), ("Acme Corporation", "Nobody", "USES", 0.9), ("Putin", "Nowhere", "ASSOCIATED_WITH", 0.3), ("Putin", "Nowhere", "ASSOCIATED_WITH", 0.8)]
    fates = rs.place_edges(spark.createDataFrame(edges, "source_name string, target_name string, rel_type string, confidence double"), merged).collect()
    assert sorted((r["target_name"], r["fate"], r["source"]) for r in fates) == [("2024", "retired", "new:1"), ("Nobody", "dropped", "new:1"), ("Nowhere", "stored", "g0"), ("Nowhere", "weak", "g0"), ("Putin", "stored", "new:1")]
    assert rs.counters(rs.merge_batch(rows.limit(0), graph_)).head()["created"] == 0


def test_brokers_have_three_edges(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("d", "f", 1.0), ("d", "g", 1.0)], "source_id string, target_id string, weight double")
    got = {r["id"]: r["is_broker"] for r in graph.structural_holes(edges).collect()}
    assert {k for k, v in got.items() if v} == {"d"}
    top = graph.brokers(edges, 2).collect()
    assert [(r["rank"], r["id"]) for r in top] == [(1, "d"), (2, "a")] and top[0]["constraint"] == round(1 / 3, 6)
