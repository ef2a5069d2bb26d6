import json

from pyspark.sql import functions as F

from sleuthgrid.functions import text as tx
from sleuthgrid.operators import network as nw
from sleuthgrid.sources import stix


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, "R") for a, b in pairs], "source_id string, target_id string, rel_type string")


def test_paths_and_components(spark):
    e = _edges(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("a", "x"), ("x", "y"), ("y", "z"), ("z", "d"), ("p", "q"), ("l", "l")])
    assert nw.shortest_path(e, "a", "d") == ["a", "b", "c", "d"]
    assert nw.shortest_path(e, "a", "a") == ["a"] and nw.shortest_path(e, "a", "q") == [] and nw.shortest_path(e, "a", "d", 2) == []
    nodes = spark.createDataFrame([(x,) for x in "abcdxyzpqlo"], "id string")
    got = {r.id: r.comp for r in nw.components(e, nodes).collect()}
    assert got == {**dict.fromkeys("abcdxyz", "a"), "p": "p", "q": "p", "l": "l", "o": "o"}


def test_long_chain(spark):
    n = [f"n{i:02d}" for i in range(40)]
    got = nw.components(_edges(spark, list(zip(n[1:], n, strict=False))), spark.createDataFrame([(x,) for x in n], "id string"))
    assert {r.comp for r in got.collect()} == {"n00"}


def test_merge_and_collapse(spark):
    e = _edges(spark, [("a", "b"), ("a2", "b"), ("a", "a2"), ("b", "b")])
    into = spark.createDataFrame([("a2", "a")], "id string, survivor string")
    assert sorted(map(tuple, nw.merge_entities(e, into).collect())) == [("a", "b", "R"), ("b", "b", "R")]
    members = spark.createDataFrame([("a", "1", "A"), ("a2", "1", "A two"), ("b", "2", "B")], "id string, comp string, name string")
    nodes, links = nw.collapse(e, members)
    assert sorted(map(tuple, nodes.collect())) == [("1", "A two (+1)", 2), ("2", "B", 1)]
    assert list(map(tuple, links.collect())) == [("1", "2", 2)]


def test_occurrences(spark):
    rows = [("aaaa", [0, 1, 2]), ("", []), (None, None), ("xaa.aa", [1, 4]), ("b", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r.at for r in df.select("i", tx.occurrences(F.col("t"), "aa").alias("at")).collect()}
    assert got == {i: at for i, (_, at) in enumerate(rows)}


def test_bundle(spark):
    ref = lambda x: [{"source_name": "mitre-attack", "external_id": x}]
    thing = lambda i, kind, x, **more: {"type": kind, "id": i, "name": i.upper(), "external_references": ref(x), **more}
    link = lambda a, kind, b, **more: {"type": "relationship", "id": a + b, "relationship_type": kind, "source_ref": a, "target_ref": b, **more}
    objects = [
        thing("t1", "attack-pattern", "T1"), thing("t2", "attack-pattern", "T1.001"), thing("g", "intrusion-set", "G1"), thing("old", "attack-pattern", "T9", revoked=True),
        thing("m", "course-of-action", "M1"), thing("gone", "intrusion-set", "G9", x_mitre_deprecated=True), {"type": "attack-pattern", "id": "none", "name": "no id"},
        link("t2", "subtechnique-of", "t1"), link("g", "uses", "t2"), link("g", "uses", "old"), link("m", "mitigates", "t1"), link("g", "likes", "t1"), link("m", "mitigates", "t2", revoked=True),
    ]
    nodes, edges = stix.read_bundle(spark.createDataFrame([(json.dumps({"objects": objects}),), ("junk",), (None,)], "value string"))
    assert sorted(map(tuple, nodes.collect())) == [("G1", "Group", "G"), ("M1", "Mitigation", "M"), ("T1", "Technique", "T1"), ("T1.001", "Technique", "T2")]
    assert sorted(map(tuple, edges.collect())) == [("G1", "T1.001", "uses"), ("M1", "T1", "mitigates"), ("T1.001", "T1", "subtechnique-of")]
