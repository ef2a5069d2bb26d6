"""Property-graph operators over edges (source_id, target_id, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .steps import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends: anchor, other, and the rest; a loop once."""
    rest = [c for c in edges.columns if c not in ("source_id", "target_id")]
    there = edges.select(F.col("source_id").alias("anchor"), F.col("target_id").alias("other"), *rest)
    back = edges.filter("source_id <> target_id").select(F.col("target_id").alias("anchor"), F.col("source_id").alias("other"), *rest)
    return there.unionByName(back)


def neighbours(edges: DataFrame, entities: DataFrame, anchors: list[str]) -> DataFrame:
    """One hop from a list of anchors, with the names of the other ends."""
    near = undirected(edges).filter(F.col("anchor").isin(anchors))
    return near.join(entities.select(F.col("id").alias("other"), "name", "entity_type"), "other")


def k_hop(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """id, hop of every node within hops of start, which is itself at 0; a start without edges has none, not even itself.

    The edges are written once, and so is each frontier, which alone is joined
    with them. The nodes seen are written frontiers, read again in each round.
    """
    both = cut(undirected(edges).select("anchor", "other").filter("anchor <> other"))
    frontier = cut(both.filter(F.col("anchor") == start).select(F.col("anchor").alias("id"), F.lit(0).alias("hop")).distinct())
    seen = frontier
    for i in range(1, hops + 1):
        new = both.join(frontier.select(F.col("id").alias("anchor")), "anchor", "left_semi").select(F.col("other").alias("id")).distinct()
        frontier = new.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(i))
        frontier = cut(frontier) if i < hops else frontier
        seen = seen.unionByName(frontier)
    return seen


def ego(edges: DataFrame, start: str, hops: int) -> tuple[DataFrame, DataFrame]:
    """The nodes within hops of start, with their distance, and all edges among them."""
    ball = cut(k_hop(edges, start, hops))
    return ball, induced(edges, ball)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    keep = nodes.select("id").distinct()
    half = edges.join(keep.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return half.join(keep.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)


def degree(edges: DataFrame) -> DataFrame:
    """id, degree, n_in, n_out over edge rows; a loop counts for both ends."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def most_connected(entities: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """The n entities of highest degree, those without edges last, ties by id."""
    return entities.join(degree(edges).select("id", "degree"), "id", "left").fillna(0, ["degree"]).orderBy(F.desc("degree"), "id").limit(n)


EDGE = ["source_id", "target_id", "rel_type"]


def corroborate(assertions: DataFrame) -> DataFrame:
    """Fold the assertions of each (source_id, target_id, rel_type) in the order of (seen, id).

    Only a different document corroborates: corroboration_count is the number
    of different documents that are named, 1 at least. The polarity (without
    case, asserts if null) is the first; any other makes the agreement CONFLICT
    for good, else it is AGREE. confidence (0 if null) is the greatest up to the
    first dissent and the least from it on. source_doc_id and evidence are the
    first that aren't empty. Nothing is gathered: every column is an aggregate,
    and only edges with a conflict are read twice.
    """
    order = F.struct("seen", "id")
    said = F.when(F.col("evidence") != "", F.col("evidence")) if "evidence" in assertions.columns else F.lit(None).cast("string")
    rows = assertions.select(*EDGE, order.alias("at"), F.lower(F.coalesce(F.when(F.col("polarity") != "", F.col("polarity")), F.lit("asserts"))).alias("polarity"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("source_doc_id") != "", F.col("source_doc_id")).alias("doc"), said.alias("said"), "seen")
    # the second of the first times of each polarity is the first dissent
    turns = rows.groupBy(*EDGE, "polarity").agg(F.min("at").alias("at")).groupBy(*EDGE).agg(F.min_by("polarity", "at").alias("polarity"), F.slice(F.array_sort(F.collect_list("at")), 2, 1).alias("second"))
    turns = turns.select(*EDGE, "polarity", F.get("second", F.lit(0)).alias("dissent"))
    whole = rows.groupBy(*EDGE).agg(
        F.greatest(F.lit(1), F.count_distinct("doc")).cast("int").alias("corroboration_count"),
        F.max("confidence").alias("confidence"),
        F.min_by("doc", F.when(F.col("doc").isNotNull(), F.col("at"))).alias("source_doc_id"),
        F.min_by("said", F.when(F.col("said").isNotNull(), F.col("at"))).alias("evidence"),
        F.min("seen").alias("first_seen"),
        F.max("seen").alias("last_seen"),
    )
    split = rows.join(turns.filter("dissent is not null").select(*EDGE, "dissent"), EDGE)
    before = F.col("at") < F.col("dissent")
    least = split.groupBy(*EDGE).agg(F.least(F.max(F.when(before, F.col("confidence"))), F.min(F.when(~before, F.col("confidence")))).alias("least"))
    out = whole.join(turns, EDGE).join(least, EDGE, "left")
    agreement = F.when(F.col("dissent").isNotNull(), "CONFLICT").otherwise("AGREE")
    return out.select(*EDGE, "corroboration_count", agreement.alias("agreement"), F.coalesce("least", "confidence").alias("confidence"), "polarity", "source_doc_id", "evidence", "first_seen", "last_seen")


def corroboration_sources(assertions: DataFrame) -> DataFrame:
    """The documents of each edge, once each, with when they first asserted it."""
    return assertions.filter("source_doc_id <> ''").groupBy(*EDGE, "source_doc_id").agg(F.min("seen").alias("first_seen"))


#: Relations that weigh half as much again (fixed values).
TACTICAL = ("TARGETS", "USES", "EXPLOITS", "COMMUNICATES_WITH", "ATTRIBUTED_TO", "COMMANDED_BY")


def weighted(assertions: DataFrame) -> DataFrame:
    """source_id, target_id, weight: one edge for each pair, that of the last assertion; confidence (0.5 if null) times 1.5 for tactical relations, to 4 places."""
    weight = F.round(F.coalesce("confidence", F.lit(0.5)) * F.when(F.col("rel_type").isin(*TACTICAL), 1.5).otherwise(1.0), 4)
    return assertions.groupBy("source_id", "target_id").agg(F.max_by(weight, F.struct("seen", "id")).alias("weight"))


def page_rank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """id, rank over edges (source_id, target_id, weight), until ranks change by less than tolerance a node in all; what dangling nodes hold is shared by all.

    Each round is written. Raises if most rounds don't settle it.
    """
    nodes = cut(nodes.select("id").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    total = edges.groupBy("source_id").agg(F.sum("weight").alias("total")).filter("total > 0")
    links = cut(edges.join(total, "source_id").select("source_id", "target_id", (F.col("weight") / F.col("total")).alias("share")))
    rank = cut(nodes.join(links.select(F.col("source_id").alias("id")).distinct().withColumn("linked", F.lit(True)), "id", "left").select("id", F.lit(1.0 / n).alias("rank"), F.coalesce("linked", F.lit(False)).alias("linked")))
    for _ in range(most):
        sent = links.join(rank.select(F.col("id").alias("source_id"), "rank"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        hung = rank.filter("not linked").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("hung")).head()["hung"]
        new = rank.join(sent, "id", "left").select("id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + hung / n)).alias("rank"), "linked", F.col("rank").alias("old"))
        new = cut(new)
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).head()[0]
        rank = new.drop("old")
        if moved < n * tolerance:
            return rank.select("id", "rank")
    raise RuntimeError(f"ranks haven't settled after {most} rounds")


def eigenvector(edges: DataFrame, nodes: DataFrame, tolerance: float = 1e-6, most: int = 1000) -> DataFrame:
    """id, centrality by power iteration over incoming edges, each node's own value added; of length 1. No rows if it doesn't settle in most rounds."""
    nodes = cut(nodes.select("id").distinct())
    n = nodes.count()
    links = cut(edges.select("source_id", "target_id").distinct())
    value = nodes.withColumn("x", F.lit(1.0 / max(1, n)))
    for _ in range(most if n else 0):
        got = links.join(value.select(F.col("id").alias("source_id"), "x"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.sum("x").alias("got"))
        raw = cut(value.join(got, "id", "left").select("id", (F.col("x") + F.coalesce("got", F.lit(0.0))).alias("y"), "x"))
        size = raw.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).head()[0] or 1.0
        moved = raw.agg(F.sum(F.abs(F.col("y") / size - F.col("x")))).head()[0]
        value = raw.select("id", (F.col("y") / size).alias("x"))
        if moved < n * tolerance:
            return value.select("id", F.col("x").alias("centrality"))
    return nodes.limit(0).withColumn("centrality", F.lit(0.0))


def distances(edges: DataFrame, sources: DataFrame, most: int = 100) -> DataFrame:
    """origin, id, hop, paths: for each source (id), all nodes that directed edges lead to, by how many hops and by how many shortest ways.

    A breadth-first search from all sources at once, a written frontier a
    round; its size is sources times what each reaches.
    """
    links = cut(edges.select("source_id", "target_id").filter("source_id <> target_id").distinct())
    frontier = cut(sources.select(F.col("id").alias("origin"), F.col("id"), F.lit(0).alias("hop"), F.lit(1.0).alias("paths")).distinct())
    seen = frontier
    for i in range(1, most + 1):
        new = frontier.join(links, frontier.id == links.source_id).groupBy("origin", F.col("target_id").alias("id")).agg(F.sum("paths").alias("paths"))
        frontier = cut(new.join(seen.select("origin", "id"), ["origin", "id"], "left_anti").select("origin", "id", F.lit(i).alias("hop"), "paths"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier)) if i % 5 == 0 else seen.unionByName(frontier)
    raise RuntimeError(f"there are ways of over {most} hops")


def closeness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, closeness: of the nodes that lead to a node, their number over the sum of their distances, times their share of all other nodes."""
    n = nodes.select("id").distinct().count()
    near = distances(edges, nodes).filter("hop > 0").groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.sum("hop").alias("far"))
    out = nodes.select("id").distinct().join(near, "id", "left")
    return out.select("id", F.coalesce(F.col("k") / F.col("far") * F.col("k") / max(1, n - 1), F.lit(0.0)).alias("closeness"))


def betweenness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, betweenness: the share of shortest ways between all other pairs that lead through a node, over the number of such pairs.

    What hangs on a node is handed back along shortest ways, from the farthest
    hop to the source, for all sources at once.
    """
    every = nodes.select("id").distinct()
    n = every.count()
    ways = cut(distances(edges, nodes))
    links = cut(edges.select("source_id", "target_id").filter("source_id <> target_id").distinct())
    last = ways.agg(F.max("hop")).head()[0] or 0
    hangs, found = None, None
    for hop in range(last, 0, -1):
        now = ways.filter(F.col("hop") == hop).select("origin", F.col("id").alias("target_id"), F.col("paths").alias("after"))
        now = now.withColumn("held", F.lit(0.0)) if hangs is None else now.join(hangs, ["origin", "target_id"], "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
        # along the links of what is one hop nearer, as the search went: who else leads to a node doesn't matter
        back = ways.filter(F.col("hop") == hop - 1).select("origin", F.col("id").alias("source_id"), "paths").join(links, "source_id").join(now, ["origin", "target_id"])
        hangs = cut(back.groupBy("origin", F.col("source_id").alias("target_id")).agg(F.sum(F.col("paths") / F.col("after") * (1 + F.col("held"))).alias("held")))
        found = hangs if found is None else found.unionByName(hangs)
    pairs = max(1, (n - 1) * (n - 2))
    if found is None:
        return every.withColumn("betweenness", F.lit(0.0))
    through = found.filter("origin <> target_id").groupBy(F.col("target_id").alias("id")).agg(F.sum("held").alias("held"))
    return every.join(through, "id", "left").select("id", (F.coalesce("held", F.lit(0.0)) / pairs).alias("betweenness"))


def _ways_round(p: DataFrame) -> DataFrame:
    """u, v, by (the sum of shares by way of common neighbours), common (how many there are) of the linked nodes of p (u, v, p, n) that have any."""
    here, back = p.select("u", "v", F.struct("n", "u").alias("at"), "p"), p.select(F.col("u").alias("v"), F.col("v").alias("u"), F.struct("n", "u").alias("to"), F.col("p").alias("back"))
    up = cut(here.join(back, ["u", "v"]).filter(F.col("at") < F.col("to")).select("u", "v", "to", "p", "back"))
    ab = up.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("to").alias("bt"), F.col("p").alias("ab"), F.col("back").alias("ba"))
    ac = up.select(F.col("u").alias("a"), F.col("v").alias("c"), F.col("to").alias("ct"), F.col("p").alias("ac"), F.col("back").alias("ca"))
    bc = up.select(F.col("u").alias("b"), F.col("v").alias("c"), F.col("p").alias("bc"), F.col("back").alias("cb"))
    round_ = ab.join(ac, "a").filter(F.col("bt") < F.col("ct")).join(bc, ["b", "c"])
    way = lambda u, v, q: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), (F.col(u + q) * F.col(q + v)).alias("way"))
    ways = round_.select(F.inline(F.array(*[way(*x) for x in ("abc", "bac", "acb", "cab", "bca", "cba")])))
    return ways.groupBy("u", "v").agg(F.sum("way").alias("by"), F.count(F.lit(1)).alias("common"))


def structural_holes(edges: DataFrame) -> DataFrame:
    """id, constraint, effective_size, is_broker of every node with a neighbour, over undirected weights (source_id, target_id, weight).

    A node's share in a neighbour is their weight, both ways, over all of its
    weights; its constraint sums (direct share + shares by way of common
    neighbours) squared. A broker has three edges or more, either way, a
    constraint under 0.5 and an effective size (neighbours less the mean number of links
    among them) over 1.5. Common neighbours are those of triangles, each of
    which is found at its node of fewest neighbours.
    """
    both = edges.filter("source_id <> target_id").select(F.inline(F.array(F.struct(F.col("source_id").alias("u"), F.col("target_id").alias("v"), "weight"), F.struct(F.col("target_id").alias("u"), F.col("source_id").alias("v"), "weight"))))
    both = both.groupBy("u", "v").agg(F.sum("weight").alias("w"))
    both = cut(both)
    total = both.groupBy("u").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"))
    p = cut(both.join(total, "u").select("u", "v", (F.col("w") / F.col("total")).alias("p"), "n"))
    by = _ways_round(p)
    local = p.join(by, ["u", "v"], "left")
    out = local.groupBy(F.col("u").alias("id")).agg(F.sum(F.pow(F.col("p") + F.coalesce("by", F.lit(0.0)), 2)).alias("constraint"), (F.max("n") - F.coalesce(F.sum("common"), F.lit(0)) / F.max("n")).alias("effective_size"))
    ends = degree(edges.select("source_id", "target_id").distinct()).select("id", "degree")
    return out.join(ends, "id").withColumn("is_broker", (F.col("degree") >= 3) & (F.col("constraint") < 0.5) & (F.col("effective_size") > 1.5)).drop("degree")


def brokers(edges: DataFrame, top: int = 20) -> DataFrame:
    """rank, id, constraint (to 6 places), effective_size (to 4), is_broker of the top nodes of least constraint, of equal ones the smallest id."""
    rounded = structural_holes(edges).withColumn("constraint", F.round("constraint", 6)).withColumn("effective_size", F.round("effective_size", 4))
    first = rounded.orderBy("constraint", "id").limit(top)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("constraint", "id")))


def shared_entity_links(edges: DataFrame, most: int = 10) -> DataFrame:
    """Pairs of targets that a source is linked to: a, b (a < b), connection_count, and up to most of the shared sources in order. No more than most are kept of a pair and task."""
    e = edges.select("source_id", "target_id").distinct()
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, F.col("a.source_id") == F.col("b.source_id")).filter("a.target_id < b.target_id").select("a.source_id", F.col("a.target_id").alias("a"), F.col("b.target_id").alias("b"))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("source_id"))
    first = pairs.withColumn("rank", rank).filter(F.col("rank") <= most).groupBy("a", "b").agg(F.array_sort(F.collect_list("source_id")).alias("shared"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("connection_count")).join(first, ["a", "b"])
