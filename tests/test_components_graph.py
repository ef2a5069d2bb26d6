"""Components of the whole graph of the tables, by brute force."""

from collections import Counter

from sleuthgrid.plans import catalog, network_queries  # noqa: F401  registers the queries
from sleuthgrid.plans.model import entities, relationships
from tests.test_queries import DATA


def test_components_of_the_whole_graph(spark):
    up = {r.id: r.id for r in entities(spark, DATA).select("id").collect()}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    edges = relationships(spark, DATA).collect()
    assert {r.rel_type for r in edges} == {"LOCATED_IN", "SUPPLIES"}
    for r in edges:
        a, b = sorted((find(r.source_id), find(r.target_id)))
        up[b] = a
    got = {r.comp: r.n for r in catalog.QUERIES["g7_components_graph"](spark, DATA).collect()}
    assert got == Counter(map(find, up)) and sum(got.values()) == len(up)
