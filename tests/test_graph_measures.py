"""Graph measures and rates against brute force on a small graph."""

import itertools
import random
from collections import defaultdict, deque

import pytest

from sleuthgrid.operators import graph as g
from sleuthgrid.operators import network as nw
from sleuthgrid.operators import profile as pf
from tests.plan_rows import most_rows

NODES = "abcdefghi"
EDGES = [("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 0.5), ("c", "d", 1.0), ("d", "b", 1.5), ("d", "e", 1.0), ("e", "f", 1.0), ("c", "f", 1.0), ("g", "h", 1.0), ("h", "h", 1.0)]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(EDGES, "source_id string, target_id string, weight double"), spark.createDataFrame([(n,) for n in NODES], "id string")


def bfs(s):
    out = defaultdict(set)
    for a, b, _ in EDGES:
        out[a].add(b)
    dist, paths, queue = {s: 0}, {s: 1}, deque([s])
    while queue:
        u = queue.popleft()
        for v in out[u]:
            if v not in dist:
                dist[v], paths[v] = dist[u] + 1, 0
                queue.append(v)
            if dist[v] == dist[u] + 1:
                paths[v] += paths[u]
    return dist, paths


def test_page_rank(spark, graph):
    n, rank = len(NODES), dict.fromkeys(NODES, 1 / len(NODES))
    total = defaultdict(float)
    for a, _, w in EDGES:
        total[a] += w
    for _ in range(200):
        hung = sum(rank[x] for x in NODES if x not in total)
        new = dict.fromkeys(NODES, 0.15 / n + 0.85 * hung / n)
        for a, b, w in EDGES:
            new[b] += 0.85 * rank[a] * w / total[a]
        rank = new
    got = {r.id: r.rank for r in g.page_rank(*graph, tolerance=1e-9).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in rank.items()} and sum(got.values()) == pytest.approx(1)
    with pytest.raises(RuntimeError):
        g.page_rank(*graph, tolerance=1e-12, most=2)


def test_closeness_and_betweenness(spark, graph):
    ways = {s: bfs(s) for s in NODES}
    close, between = {}, dict.fromkeys(NODES, 0.0)
    for v in NODES:
        d = [ways[s][0][v] for s in NODES if s != v and v in ways[s][0]]
        close[v] = len(d) / sum(d) * len(d) / (len(NODES) - 1) if d else 0.0
    for s, t, v in itertools.permutations(NODES, 3):
        ds, ps = ways[s]
        dv, pv = ways[v]
        if t in ds and v in ds and t in dv and ds[v] + dv[t] == ds[t]:
            between[v] += ps[v] * pv[t] / ps[t] / ((len(NODES) - 1) * (len(NODES) - 2))
    assert {r.id: r.closeness for r in g.closeness(*graph).collect()} == {k: pytest.approx(x) for k, x in close.items()}
    assert {r.id: r.betweenness for r in g.betweenness(*graph).collect()} == {k: pytest.approx(x) for k, x in between.items()}


def test_eigenvector(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "c")]
    x = dict.fromkeys("abc", 1 / 3)
    for _ in range(500):
        y = {v: x[v] + sum(x[a] for a, b in edges if b == v) for v in x}
        size = sum(v * v for v in y.values()) ** 0.5
        x = {k: v / size for k, v in y.items()}
    df = spark.createDataFrame(edges, "source_id string, target_id string")
    got = g.eigenvector(df, spark.createDataFrame([("a",), ("b",), ("c",)], "id string"))
    assert {r.id: r.centrality for r in got.collect()} == {k: pytest.approx(v, abs=1e-4) for k, v in x.items()}
    assert g.eigenvector(df, spark.createDataFrame([("a",)], "id string"), most=0).count() == 0


def test_hops_paths_and_components(spark, graph):
    edges, nodes = graph
    assert {r.id: r.hop for r in g.k_hop(edges, "a", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "f": 2}
    assert g.k_hop(edges, "i", 3).count() == 0
    ball, inner = g.ego(edges, "e", 1)
    assert ball.count() == 3 and {(r.source_id, r.target_id) for r in inner.collect()} == {("d", "e"), ("e", "f")}
    assert nw.shortest_path(edges, "a", "e") == ["a", "b", "d", "e"] and nw.shortest_path(edges, "a", "g") == []
    assert {r.id: r.comp for r in nw.components(edges, nodes).collect()} == {**dict.fromkeys("abcdef", "a"), "g": "g", "h": "g", "i": "i"}


def test_conflicts(spark):
    rows = [("x", "y", 0.4, "d1", None), ("x", "y", 0.9, "d1", "Asserts"), ("x", "y", 0.6, "", "denies"), ("x", "y", 0.8, "d2", "asserts"), ("x", "z", None, "", ""), ("x", "w", 0.3, None, "DENIES"), ("x", "w", 0.5, "d9", "denies")]
    df = spark.createDataFrame([(*r, "e" if i else "", i, i) for i, r in enumerate(rows)], "source_id string, target_id string, confidence double, source_doc_id string, polarity string, evidence string, seen int, id int").selectExpr("*", "'R' AS rel_type")
    got = {r.target_id: r for r in g.corroborate(df).collect()}
    y, z, w = got["y"], got["z"], got["w"]
    assert (y.corroboration_count, y.agreement, y.confidence, y.polarity, y.source_doc_id, y.evidence) == (2, "CONFLICT", 0.6, "asserts", "d1", "e")
    assert (z.corroboration_count, z.agreement, z.confidence, z.polarity, z.source_doc_id) == (1, "AGREE", 0.0, "asserts", None)
    assert (w.corroboration_count, w.agreement, w.confidence, w.polarity, w.source_doc_id) == (1, "AGREE", 0.5, "denies", "d9")


def test_rejected_requests_do_not_count(spark):
    rng = random.Random(6)
    rows = [(i, f"u{rng.randrange(4)}", rng.randrange(600)) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, who string, t long").selectExpr("i", "who", "timestamp_seconds(t) AS at")
    want, held = {}, defaultdict(list)
    for i, who, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        held[who] = [x for x in held[who] if t - x < 60]
        want[i] = (len(held[who]), len(held[who]) >= 5)
        if len(held[who]) < 5:
            held[who].append(t)
    got = {r.i: (r.recent, r.rejected) for r in pf.rate_exceeded(df, "who", "at", "i", 60, 5).collect()}
    assert got == want and any(x for _, x in want.values())


def test_hubs_make_no_pairs(spark):
    """Rows of betweenness and of structural holes grow with the links of hubs and not with their square."""
    n = 400
    up = [(f"a{i}", "hub") for i in range(n)] + [("hub", "top")]
    edges = spark.createDataFrame(up, "source_id string, target_id string")
    nodes = spark.createDataFrame([(x,) for x in sorted({y for e in up for y in e})], "id string")
    got = {}
    assert most_rows(spark, lambda: got.update({r["id"]: r["betweenness"] for r in g.betweenness(edges, nodes).collect()})) < 20 * n
    assert abs(got["hub"] - n / ((n + 1) * n)) < 1e-12 and sum(v > 0 for v in got.values()) == 1
    tied = spark.createDataFrame([(a, b, 1.0) for a, b in up] + [("a0", "a1", 2.0)], "source_id string, target_id string, weight double")
    found = []
    assert most_rows(spark, lambda: found.extend(g.structural_holes(tied).collect())) < 20 * n
    found = {r["id"]: r for r in found}
    assert abs(found["a0"]["constraint"] - ((5 / 9) ** 2 + (2 / 3 + 1 / 3 / (n + 1)) ** 2)) < 1e-12 and found["a0"]["effective_size"] == 1.0
    assert abs(found["hub"]["effective_size"] - (n + 1 - 2 / (n + 1))) < 1e-9 and found["hub"]["is_broker"] and found["a5"]["constraint"] == 1.0


def test_structural_holes_are_brute_force(spark):
    rng = random.Random(8)
    rows = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", rng.randrange(1, 5) + 0.0) for _ in range(45)]
    w = defaultdict(float)
    for a, b, x in rows:
        if a != b:
            w[a, b] += x
            w[b, a] += x
    near = defaultdict(set)
    for a, b in w:
        near[a].add(b)
    p = {(a, b): x / sum(w[a, c] for c in near[a]) for (a, b), x in w.items()}
    got = {r["id"]: (r["constraint"], r["effective_size"]) for r in g.structural_holes(spark.createDataFrame(rows, "source_id string, target_id string, weight double")).collect()}
    assert set(got) == set(near)
    for u, (constraint, size) in got.items():
        assert abs(constraint - sum((p[u, v] + sum(p[u, q] * p[q, v] for q in near[u] & near[v])) ** 2 for v in near[u])) < 1e-12
        assert abs(size - (len(near[u]) - sum(len(near[u] & near[v]) for v in near[u]) / len(near[u]))) < 1e-12
