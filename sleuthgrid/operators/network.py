"""Paths, components, communities, merges and attribution over edges (source_id, target_id, rel_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import degree, k_hop, undirected
from .steps import cut


def shortest_path(edges: DataFrame, start: str, end: str, most: int = 10) -> list[str]:
    """Nodes of a shortest undirected path of at most most edges; of equal paths, the one with the smallest nodes from the end back. No path: an empty list.

    Each round joins the last written frontier alone, whose rows hold their way
    (of at most most nodes); what comes to the driver is one row a round.
    """
    if start == end:
        return [start]
    both = cut(undirected(edges).select("anchor", "other").filter("anchor <> other"))
    frontier = edges.sparkSession.createDataFrame([(start, [start])], "id string, way array<string>")
    seen = frontier.select("id")
    for _ in range(most):
        new = both.join(frontier.select(F.col("id").alias("anchor"), "way"), "anchor").groupBy(F.col("other").alias("id")).agg(F.min(F.struct("anchor", "way")).alias("by"))
        frontier = cut(new.join(seen, "id", "left_anti").select("id", F.concat("by.way", F.array("id")).alias("way")))
        seen = seen.unionByName(frontier.select("id"))
        state = frontier.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("id") == end, F.col("way"))).alias("way")).head()
        if state["way"]:
            return state["way"]
        if state["n"] == 0:
            break
    return []


def common_surroundings(edges: DataFrame, a: str, b: str, hops: int = 2) -> DataFrame:
    """id of the nodes, other than a and b, within hops of both."""
    near = lambda x: k_hop(edges, x, hops).select("id")
    return near(a).join(near(b), "id", "left_semi").filter(~F.col("id").isin(a, b))


def components(edges: DataFrame, nodes: DataFrame, most: int = 60) -> DataFrame:
    """id, comp: the smallest id that each node is joined to, by least labels of neighbours and of labels' labels. Raises if most rounds don't do."""
    both = cut(undirected(edges).select("anchor", "other").filter("anchor <> other").distinct())
    comp = nodes.select("id").distinct().withColumn("comp", F.col("id"))
    for _ in range(most):
        near = both.join(comp, both.other == comp.id).groupBy("anchor").agg(F.min("comp").alias("near"))
        step = comp.join(near, comp.id == near.anchor, "left").select("id", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        jump = comp.select(F.col("id").alias("to"), F.col("comp").alias("further"))
        after = cut(step.join(jump, "to", "left").select("id", F.least("to", "further").alias("comp"), "was"))
        comp = after.select("id", "comp")
        if not after.filter("comp <> was").limit(1).count():
            return comp
    raise RuntimeError(f"components haven't settled after {most} rounds")


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """n_nodes, n_edges (distinct directed pairs) and their share of all n (n - 1) pairs."""
    e = edges.select("source_id", "target_id").distinct().agg(F.count(F.lit(1)).alias("n_edges"))
    n = nodes.select("id").distinct().agg(F.count(F.lit(1)).alias("n_nodes"))
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return n.join(F.broadcast(e)).select("n_nodes", "n_edges", F.when(pairs > 0, F.col("n_edges") / pairs).otherwise(0.0).alias("density"))  # one row each


def collapse(edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Super-nodes (comp, name, size) named after the member (id, comp, name) of most edges, and undirected weights between them (a < b)."""
    d = members.join(degree(edges).select("id", "degree"), "id", "left")
    lead = F.max_by("name", F.struct(F.coalesce("degree", F.lit(0)), "name"))
    size = F.count(F.lit(1))
    nodes = d.groupBy("comp").agg(lead.alias("lead"), size.alias("size")).select("comp", F.when(F.col("size") > 1, F.concat("lead", F.lit(" (+"), (F.col("size") - 1).cast("string"), F.lit(")"))).otherwise(F.col("lead")).alias("name"), "size")
    side = lambda end, to: members.select(F.col("id").alias(end), F.col("comp").alias(to))
    e = edges.join(side("source_id", "x"), "source_id").join(side("target_id", "y"), "target_id").filter("x <> y")
    return nodes, e.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("weight"))


def merge_entities(edges: DataFrame, into: DataFrame) -> DataFrame:
    """Rewrite ends by (id, survivor); an edge that would become a loop goes, one that is there twice stays once."""
    side = lambda end, to: into.select(F.col("id").alias(end), F.col("survivor").alias(to))
    moved = edges.join(side("source_id", "s"), "source_id", "left").join(side("target_id", "t"), "target_id", "left")
    ends = moved.select(F.coalesce("s", "source_id").alias("source_id"), F.coalesce("t", "target_id").alias("target_id"), "rel_type", (F.col("s").isNotNull() | F.col("t").isNotNull()).alias("moved"))
    return ends.filter(~F.col("moved") | (F.col("source_id") != F.col("target_id"))).drop("moved").distinct()


def detach(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without an end among gone (id)."""
    half = edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    return half.join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(*edges.columns)


def survivors(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def co_occurrence(mentions: DataFrame, within: str, order: str, what: str, reach: int = 2) -> DataFrame:
    """a, b, n: how often b follows a within reach places of the same sentence; one window, no self-join."""
    w = Window.partitionBy(within).orderBy(order)
    ahead = F.array(*[F.lead(what, i).over(w) for i in range(1, reach + 1)])
    pairs = mentions.select(F.col(what).alias("a"), ahead.alias("ahead")).select("a", F.explode("ahead").alias("b")).filter("b is not null and a <> b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def attribution(uses: DataFrame, observed: DataFrame, n: int = 10) -> DataFrame:
    """The n groups (group, technique) that share most observed techniques: group, shared, coverage."""
    seen = observed.select("technique").distinct()
    total = seen.agg(F.count(F.lit(1)).alias("total"))
    shared = uses.select("group", "technique").distinct().join(seen, "technique", "left_semi").groupBy("group").agg(F.count(F.lit(1)).alias("shared"))
    out = shared.join(F.broadcast(total)).select("group", "shared", F.round(F.col("shared") / F.col("total"), 4).alias("coverage"))  # total is one row
    return out.orderBy(F.desc("shared"), F.desc("coverage"), "group").limit(n)
