"""Agglomerative clustering by Ward's criterion, and cuts of its tree.

Ward's distance is reducible: two clusters that are each other's nearest stay
so whatever else is merged. So all such pairs are merged in one round, and the
table of merges is that of merging one pair at a time. Nearest clusters are
searched in blocks of clusters against blocks of clusters; the last LAST
clusters, whatever there was, are merged by one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .steps import Rounds

#: Clusters are compared in blocks of about so many, and so many are left to one task.
BLOCK, LAST = 12_000, 12_000
#: Most clusters of a level, and levels, of each granularity (fixed values).
GRANULARITY = {"broad": (5, 2), "medium": (12, 4), "detailed": (30, 6)}


def _closest(ids, x, a, names, y, b):
    """For each of ids the nearest of names (in order) and its squared distance 2ab/(a+b) |x-y|^2, of equal ones the smallest id.

    Products tell which can be the nearest, within what their rounding can
    come to; these alone are compared by differences, so equal vectors are at 0.
    """
    out_d, out_o = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    slack = 16 * (x.shape[1] + 8) * np.finfo(float).eps * (xx + yy.max(initial=0.0))
    at_self = np.minimum(np.searchsorted(names, ids), len(names) - 1)
    itself = names[at_self] == ids
    single = (a == 1).all() and (b == 1).all()
    step = max(1, 4_000_000 // len(names))
    for i in range(0, len(ids), step):
        part = slice(i, i + step)
        s = x[part] @ y.T
        s *= -2
        s += xx[part, None]
        s += yy[None, :]
        own = np.flatnonzero(itself[part])
        s[own, at_self[part][own]] = np.inf
        if single:
            low, wide = s, 2 * slack[part]
        else:
            weight = b[None, :] / (a[part, None] + b[None, :])
            weight *= 2 * a[part, None]
            s -= slack[part, None]
            s *= weight
            low, wide = s, None
        least = low.min(axis=1)
        if single:
            rows, cols = np.nonzero(low <= (least + wide)[:, None])
        else:  # the least upper bound is at most that of the least lower bound
            at = low.argmin(axis=1)
            upper = least + 2 * slack[part] * weight[np.arange(len(at)), at]
            rows, cols = np.nonzero(low <= upper[:, None])
        for k in range(0, len(rows), 500_000):
            r, c = rows[k : k + 500_000], cols[k : k + 500_000]
            d = 2 * a[part][r] * b[c] / (a[part][r] + b[c]) * ((y[c] - x[part][r]) ** 2).sum(axis=1)
            d[names[c] == ids[part][r]] = np.inf
            order = np.lexsort((names[c], d, r))
            first = order[np.r_[True, r[order][1:] != r[order][:-1]]]
            better = d[first] < out_d[part][r[first]]
            out_d[i + r[first][better]], out_o[i + r[first][better]] = d[first][better], names[c[first][better]]
    return out_o, out_d


def _sides(rows):
    rows = rows.sort_values("id")
    return rows["id"].to_numpy(), np.stack(rows["centre"].to_list()).astype(float), rows["n"].to_numpy().astype(float)


def _nearest(key, mine, others):
    """The nearest of others for each of mine."""
    import pandas as pd

    if not len(mine) or not len(others):
        return pd.DataFrame({"id": [], "other": [], "d": []})
    ids, x, a = _sides(mine)
    other, d = _closest(ids, x, a, *_sides(others))
    found = pd.DataFrame({"id": ids, "other": other, "d": d})
    return found[np.isfinite(found["d"])]


def _rest(rows):
    """The merges of at most LAST clusters, in rounds as in merges."""
    import pandas as pd

    ids, x, n = _sides(rows)
    out = []
    near, d = _closest(ids, x, n, ids, x, n)
    while len(ids) > 1:
        at = np.searchsorted(ids, near)
        a = np.flatnonzero((near[at] == ids) & (ids < near))
        if not len(a):
            raise RuntimeError("no two clusters are each other's nearest")
        b = at[a]
        x[a] = (x[a] * n[a, None] + x[b] * n[b, None]) / (n[a] + n[b])[:, None]
        n[a] += n[b]
        out.append(pd.DataFrame({"a": ids[a], "b": ids[b], "height": np.sqrt(d[a]), "n": n[a].astype(np.int64)}))
        gone = np.zeros(len(ids), bool)
        gone[a] = gone[b] = True
        new = gone | gone[at]
        keep = np.ones(len(ids), bool)
        keep[b] = False
        ids, x, n, near, d, new = ids[keep], x[keep], n[keep], near[keep], d[keep], np.flatnonzero(new[keep])
        near[new], d[new] = _closest(ids[new], x[new], n[new], ids, x, n)
        # a new cluster may also be nearer to an old one than its nearest, at equal distance
        to = np.searchsorted(ids, near[new])
        for i in np.flatnonzero((d[new] < d[to]) | (d[new] == d[to]) & (ids[new] < near[to])):
            if (d[new[i]], ids[new[i]]) < (d[to[i]], near[to[i]]):
                near[to[i]], d[to[i]] = ids[new[i]], d[new[i]]
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "height": [], "n": []})


def merges(vectors: DataFrame) -> DataFrame:
    """a, b, height, n of every merge of vectors (id long, once each; vector): clusters a < b become a; height is Ward's, that two single ones have their distance.

    A cluster is known by its smallest id. Null vectors, and those that aren't
    as wide as the first of the smallest id, belong to no cluster. Only clusters
    whose nearest has gone, or that are new, are compared again.
    """
    rounds = Rounds(vectors.sparkSession)
    rows = vectors.select(F.col("id").cast("long"), F.col("vector").cast("array<double>").alias("centre")).filter("id is not null and centre is not null")
    wide = rows.orderBy("id").select(F.size("centre")).head()
    if wide:
        rows = rows.filter(F.size("centre") == wide[0])
    # equal vectors are merged first, by id, at height 0
    rows = rounds.keep("rows", rows)
    left = rounds.keep("left", rows.groupBy("centre").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "centre", "n"))
    copies = Window.partitionBy("centre").orderBy("id")
    same = rows.select("id", F.min("id").over(copies).alias("a"), F.row_number().over(copies).cast("long").alias("n")).filter("n > 1")
    done = rounds.keep("done", same.select("a", F.col("id").alias("b"), F.lit(0.0).alias("height"), "n"))
    near, n, turn = None, left.count(), 0
    done = [done]
    while n > LAST:
        turn += 1
        fresh = n if near is None else n - near.count()
        i, j = -(-fresh // BLOCK), -(-n // BLOCK)
        j = max(j, min(16, n // 500)) if i == 1 else j  # few are compared with all: in smaller blocks
        new = left if near is None else left.join(near.select("id"), "id", "left_anti")
        dealt = lambda df, c, k: df.withColumn(c, F.pmod(F.hash("id"), F.lit(k)))
        spread = lambda df, c, k: df.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        again = left.select(*[F.col(c).alias(c) for c in ("id", "centre", "n")])  # columns of its own, for the cogroup
        mine, others = spread(dealt(new, "i", i), "j", j), spread(dealt(again, "j", j), "i", i)
        found = mine.groupBy("i", "j").cogroup(others.groupBy("i", "j")).applyInPandas(_nearest, "id long, other long, d double")
        found = found.groupBy("id").agg(F.min(F.struct("d", "other")).alias("m")).select("id", "m.other", "m.d")
        if near is not None:  # a new cluster may also be nearer to an old one than its nearest, at equal distance
            found = rounds.keep("found", found)
            kept = near.unionByName(found.select(F.col("other").alias("id"), F.col("id").alias("other"), "d").join(near.select("id"), "id", "left_semi"))
            found = found.unionByName(kept.groupBy("id").agg(F.min(F.struct("d", "other")).alias("m")).select("id", "m.other", "m.d"))
        near = rounds.keep("near", found)
        back = near.select(F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = near.filter("id < other").join(back, ["id", "other"])
        side = lambda c, p: left.select(F.col("id").alias(c), F.col("centre").alias(f"{p}c"), F.col("n").alias(f"{p}n"))  # noqa: B023,E731
        both = pairs.join(side("id", "a"), "id").join(side("other", "b"), "other")
        mean = F.zip_with("ac", "bc", lambda u, v: (u * F.col("an") + v * F.col("bn")) / (F.col("an") + F.col("bn")))
        merged = rounds.keep(f"merged-{turn}", both.select("id", "other", "d", mean.alias("centre"), (F.col("an") + F.col("bn")).alias("n")))
        done.append(merged.select(F.col("id").alias("a"), F.col("other").alias("b"), F.sqrt("d").alias("height"), "n"))
        gone = merged.select(F.explode(F.array("id", "other")).alias("id"))
        left = rounds.keep("left", left.join(gone, "id", "left_anti").unionByName(merged.select("id", "centre", "n")))
        near = rounds.keep("kept", near.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "other"), "other", "left_anti").select("id", "other", "d"))
        joined = merged.count()
        if not joined:
            raise RuntimeError("no two clusters are each other's nearest")
        n -= joined
    if n > 1:
        done.append(rounds.keep("done-last", left.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_rest, "a long, b long, height double, n long")))
    out = done[0]
    for step in done[1:]:
        out = out.unionByName(step)
    return rounds.keep("done", out)


def cut_at(vectors: DataFrame, tree: DataFrame, counts: list[int]) -> DataFrame:
    """k, id, cluster (its smallest id) of the tree's cuts into each number of clusters (as many as vectors at most).

    The cut into k undoes the k - 1 highest merges, of equal ones the later.
    A vector's cluster is found by following merges to smaller ids, in rounds
    that double how far each goes.
    """
    rounds = Rounds(vectors.sparkSession)
    # one row for each merge; ranks need one order of them all, by height and then by size, so that a cluster's merges come in turn
    order = Window.orderBy(F.desc("height"), F.desc("n"), F.desc("a"), F.desc("b"))
    ranks = rounds.keep("ranks", tree.select("a", "b", F.row_number().over(order).alias("rank")))
    ids = vectors.select(F.col("id").cast("long").alias("id")).filter("id is not null").distinct()
    most = max(counts)
    whole = _followed(rounds, "whole", ids.withColumn("k", F.lit(int(most))), ranks)
    # the other cuts join clusters of the finest, which are few
    ks = F.explode(F.array(*[F.lit(int(k)) for k in counts])).alias("k")
    few = _followed(rounds, "few", whole.select(F.col("cluster").alias("id")).distinct().select("id", ks), ranks)
    return whole.select("id", F.col("cluster").alias("at")).join(few.select("k", F.col("id").alias("at"), "cluster"), "at").select("k", "id", "cluster")


def _followed(rounds: Rounds, name: str, ids: DataFrame, ranks: DataFrame) -> DataFrame:
    """k, id, cluster: where the merges of rank k or more lead each of ids (k, id)."""
    start = ids.join(ranks.select(F.col("b").alias("id"), "a", "rank"), "id", "left")
    step = rounds.keep(f"{name}-0", start.select("k", "id", F.when(F.col("rank") >= F.col("k"), F.col("a")).otherwise(F.col("id")).alias("cluster")))
    i = 0
    while True:
        i += 1
        over = step.select("k", F.col("id").alias("cluster"), F.col("cluster").alias("next"))
        after = rounds.keep(f"{name}-{i}", step.join(over, ["k", "cluster"]).select("k", "id", F.col("next").alias("cluster"), (F.col("next") != F.col("cluster")).alias("moved")))
        still = after.filter("moved").isEmpty()
        step = after.drop("moved")
        if still:
            return step


def level_counts(n: int, granularity: str) -> list[int]:
    """How many clusters each level has."""
    most, levels = GRANULARITY[granularity]
    out = []
    for level in range(1, levels + 1):
        k = max(2, min(most, n // level))
        out.append(max(2, n - 1) if k >= n else k)
    return out


def semantic_levels(vectors: DataFrame, granularities: tuple[str, ...] = tuple(GRANULARITY)) -> DataFrame:
    """granularity, level, id, cluster of vectors (id, vector): every level of every granularity, from one tree."""
    tree = merges(vectors)
    n = tree.count() + 1
    wanted = [(g, i, k) for g in granularities for i, k in enumerate(level_counts(n, g), 1)]
    cuts = cut_at(vectors, tree, sorted({k for *_, k in wanted}))
    plan = vectors.sparkSession.createDataFrame(wanted, "granularity string, level int, k int")
    return cuts.join(F.broadcast(plan), "k").select("granularity", "level", "id", "cluster")
