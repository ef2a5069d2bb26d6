"""Near-duplicate texts by DartMinHash signatures and banded joining.

Darts are thrown on each element of a weighted set: a hash of the element
drives a Poisson process of unit rate over (weight, rank). A dart counts if it
lands below the element's weight, and carries one of k coordinates; the
signature has, for each coordinate, the dart of the lowest rank. Two sets have
the same dart in a coordinate with probability equal to their weighted Jaccard
likeness. The plane is cut into fixed regions, each with its own hash, so that
all sets throw the same darts; a set of n elements looks only at ranks up to
about (k ln k + 2k) / total weight, where most elements have no dart at all.

Bands of a signature are joined on equality. Inside a band every text is
compared with leaders, not with every other; what leaders leave in different
groups is compared by a join inside the band that yields only pairs whose bit sketches
are close. All pairs are verified by the exact likeness of the whole sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, released, schema_of, spread_join, texts
from .components import connected
from .hashing import mix, window_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: 26 bands of 5: a pair at the threshold is missed with probability (1 - 0.8**5)**26 = 3.3e-5.
BANDS, ROWS = 26, 5
#: The rank axis is cut at these powers of two, then into unit steps.
_LOW_RANKS = (-12, -10, -8, -6, -4, -2, 0)
_UNIT = float(2.0**-53)
#: Darts of the finer sketch, which only texts that leaders leave apart get, and its columns.
FINE = 1024
BITS = [f"b{i}" for i in range(FINE // 32)]


def shingles(text: bytes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of runs of size words, and how often each occurs; a shorter text is one shingle of all its words; no word, none."""
    words = word_hashes(text)
    if 0 < len(words) < size:
        return window_hashes(words, len(words), 40 + len(words)), np.ones(1, np.int64)
    return np.unique(window_hashes(words, size), return_counts=True)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * _UNIT


def signature(elements: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """The k darts of a weighted set of hashed elements (distinct, weights over 0); at least one element."""
    if weights is None:
        total, levels = float(len(elements)), [(0.0, 1.0, None)]
    else:
        total, levels, low, high = float(weights.sum()), [], 0.0, 1.0
        while low < weights.max():
            levels.append((low, high, weights > low))
            low, high = high, high * 2
    limit = (k * math.log(k) + 2 * k) / total
    best_rank, best_dart = np.full(k, np.inf), np.zeros(k, np.uint64)
    done = 0.0
    while True:
        edges = np.array([0.0, *[2.0**e for e in _LOW_RANKS], *range(2, math.ceil(limit) + 2)])
        pick = (edges[:-1] < limit) & (edges[:-1] >= done)
        left, right = edges[:-1][pick], edges[1:][pick]
        for number, (low, high, mask) in enumerate(levels):
            own = elements if mask is None else elements[mask]
            seeds = ((right * 4096).astype(np.uint64) * np.uint64(64) + np.uint64(number)) * np.uint64(0x9E3779B97F4A7C15)
            h = mix(own[None, :] ^ seeds[:, None]).reshape(-1)
            u, row = _uniform(h), np.repeat(np.arange(len(left)), len(own))
            # a region's number of darts is Poisson; all regions at once, then those with a second dart, and so on
            area = (high - low) * (right - left)
            p, cut, at, n = np.exp(-area), np.exp(-area), np.arange(len(h)), 0
            found = []
            while len(at := at[u[at] > np.minimum(cut, 1 - 1e-12)[row[at]]]):
                n += 1
                found.append((mix(h[at] + np.uint64(n * 0xD1B54A32D192ED03 & (1 << 64) - 1)), at))
                p = p * area / n
                cut = cut + p
            if not found:
                continue
            dart, at = (np.concatenate(x) for x in zip(*found, strict=True))
            if weights is not None:
                below = low + (high - low) * _uniform(mix(dart + np.uint64(1))) < weights[mask][at % len(own)]
                dart, at = dart[below], at[below]
            at = row[at]
            rank = left[at] + (right - left)[at] * _uniform(mix(dart + np.uint64(2)))
            place = (mix(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64)
            order = np.argsort(-rank, kind="stable")
            place, rank, dart = place[order], rank[order], dart[order]
            ranks, darts = np.full(k, np.inf), np.zeros(k, np.uint64)
            ranks[place], darts[place] = rank, dart  # of equal places the last, of lowest rank, stays
            less = ranks < best_rank
            best_rank[less], best_dart[less] = ranks[less], darts[less]
        done = max(done, float(right[-1])) if len(right) else done
        # every region that begins below done has been looked at whole
        if np.all(best_rank <= done):
            return best_dart
        limit = max(limit, done) * 2


def band_keys(own: np.ndarray, weights: np.ndarray | None, bands: int, rows: int) -> np.ndarray:
    """One key for each band of the signature of a weighted set of shingles."""
    sig = signature(own, weights, bands * rows)
    keys = np.zeros(bands, np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(3) + sig.reshape(bands, rows)[:, r])
    return mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)


def fine_bits(own: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
    """Two bits of each of FINE darts, low bits first: they differ for a dart with probability 3/4 (1 - likeness)."""
    two = (mix(signature(own, weights, FINE) + np.uint64(77)) >> np.uint64(62)).astype(np.uint8)
    return np.packbits(np.stack([two & 1, two >> 1]), axis=1).view(np.int64).reshape(-1)


def _weights(times: np.ndarray, counts: bool) -> np.ndarray | None:
    return times.astype(np.float64) if counts and len(times) and times.max() > 1 else None


def _bands(bands: int, rows: int, counts: bool):
    """id, sha and the band keys of each text; no bands for one without words."""

    def run(batches):
        for batch in batches:
            known: dict[bytes, np.ndarray] = {}
            shas, values, ends = batch.column("sha").to_pylist(), [], [0]
            for sha, text in zip(shas, texts(batch, "text"), strict=True):
                if sha not in known:
                    own, times = shingles(text)
                    known[sha] = band_keys(own, _weights(times, counts), bands, rows) if len(own) else np.empty(0, np.int64)
                values.append(known[sha])
                ends.append(ends[-1] + len(known[sha]))
            flat = np.concatenate(values) if values else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("id"), batch.column("sha"), lists], names=["doc_id", "id", "sha", "bands"])

    return released(run)


def _fine(counts: bool):
    def run(batches):
        for batch in batches:
            found = [fine_bits(own, _weights(times, counts)) for own, times in map(shingles, texts(batch, "text"))]
            if found:
                table = np.stack(found)
                yield pa.record_batch([batch.column("id"), *[pa.array(table[:, i]) for i in range(table.shape[1])]], names=["id", *BITS])

    return released(run)


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], counts: bool) -> float:
    """Exact Jaccard likeness of two sets of shingles, weighted by how often each occurs if counts."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if counts:
        both, sizes = int(np.minimum(x[1][i], y[1][j]).sum()), int(x[1].sum() + y[1].sum())
    else:
        both, sizes = len(i), len(x[0]) + len(y[0])
    return both / max(1, sizes - both)


def _likeness(counts: bool):
    def run(batches):
        last, left = None, None
        for batch in batches:
            out = []
            for a, b in zip(texts(batch, "text_a"), texts(batch, "text_b"), strict=True):
                if a != last:
                    last, left = a, shingles(a)
                out.append(likeness(left, shingles(b), counts))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "likeness"])

    return released(run)


def verify(ws: Workspace, pairs: DataFrame, reps: DataFrame, name: str, counts: bool = False, share: int = 1000) -> DataFrame:
    """pairs (a, b) of ids with their likeness, from the texts of reps.

    b's text goes to a's; the pairs of one a are dealt into parts of about
    share, each of which gets a's text once, so a leader of many isn't in one task.
    """
    own = reps.select("id", "text")
    parts = ws.write(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / share).cast("int")), f"{name}-parts", small=True)
    leaders = own.hint("merge").join(parts.select(F.col("a").alias("id"), "parts"), "id").select(F.col("id").alias("a"), F.col("text").alias("text_a"), "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = spread_join(pairs, parts, ["a"], "n").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    with_b = dealt.join(own.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    with_both = with_b.join(leaders.drop("parts").hint("merge"), ["a", "part"])
    out = ws.write(with_both.select("a", "b", "text_a", "text_b").mapInArrow(_likeness(counts), schema_of("a long, b long, likeness double")), name, small=True)
    ws.drop(f"{name}-parts")
    return out


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


def _sha(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def text_key(doc_id: Column, text: Column) -> Column:
    """A number for each pair of doc_id and text; a class has that of its text and smallest doc_id."""
    return F.xxhash64(_sha(text), _id(doc_id))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, rounds: int = 2, counts: bool = False) -> DataFrame:
    """Group documents whose word 5-shingles are alike: doc_id, class_id, group_id, group_key, n_joining_links.

    Likeness is Jaccard's of the sets of shingles, all of weight 1; with counts
    it is the weighted one, and a shingle weighs as often as it occurs.
    class_id: smallest doc_id of the documents with the same text. group_id:
    smallest class_id among those joined by chains of pairs with likeness of
    threshold or more. group_key: the text_key of the group's first class, by
    class_id and then by text; it tells groups apart whose group_id is the same,
    as null or repeated doc_ids make them. n_joining_links: verified links of
    the class that joined its group; pairs already in one group aren't compared.
    A pair is missed if no band has it (3.3e-5 at the threshold), or if leaders
    leave it apart and its finer sketches differ by over 4.5 standard errors
    more than those of a pair at the threshold do (3.4e-6). Texts and
    classes go by 64-bit keys: of n texts, about n*n/2**65 pairs share one.

    A null text counts as empty; a text without words has no links, but empty
    texts are one class; a text of under five words is one shingle; however
    long, a text is compared whole. A null doc_id counts as the smallest. Rows
    that share a doc_id may differ in text, and each gets its text's class; rows
    repeat in the result as in the table. Other columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "minhash")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = base.withColumn("id", _id(F.col("doc_id"))).withColumn("sha", _sha(F.col("text")))
    every = ws.write(keyed.mapInArrow(_bands(bands, rows, counts), schema_of("doc_id long, id long, sha binary, bands array<long>")), "every")
    # a text's class has its own number: documents of one id may differ in text
    classes = every.groupBy("sha").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n"))
    classes = ws.write(classes.withColumn("key", F.xxhash64("sha", "id")), "classes", small=True)
    members = ws.write(spread_join(every.select("doc_id", "sha"), classes.select("sha", F.col("id").alias("class_id"), "key", "n"), ["sha"], "n").select("doc_id", "class_id", "key"), "members", small=True)
    ws.drop("every")
    in_bands = classes.select(F.col("key").alias("id"), F.explode("bands").alias("band"))
    shared = in_bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = ws.write(in_bands.join(shared, "band"), "buckets", small=True)
    # the text that shares most bands with others is likest to all: the source of copies leads its buckets
    fame = ws.write(buckets.groupBy("id").agg(F.sum("size").alias("fame")), "fame", small=True)
    buckets = buckets.drop("size")
    reps = keyed.select(F.xxhash64("sha", "id").alias("id"), "text").join(fame.select("id").hint("merge"), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    reps = ws.write(reps, "texts")
    edges, seen, drop = None, None, []
    comp = ws.write(fame.select("id", F.col("id").alias("comp")), "comp-start", small=True)
    for number in range(rounds):
        now = buckets.join(comp.join(fame, "id"), "id")
        first = now.groupBy("band").agg(F.max(F.struct("fame", "id", "comp")).alias("leader"))
        if number:  # the leader comes from those that the first leader's group has left
            rest = now.join(first, "band").filter(F.col("comp") != F.col("leader.comp"))
            first = rest.groupBy("band").agg(F.max(F.struct("fame", "id", "comp")).alias("leader"))
        pairs = now.join(first, "band").filter(F.col("comp") != F.col("leader.comp"))
        pairs = pairs.select(F.least("id", "leader.id").alias("x"), F.greatest("id", "leader.id").alias("y"), F.col("leader.id").alias("a"))
        pairs = pairs.groupBy("x", "y").agg(F.max("a").alias("a")).select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"), "x", "y")
        if seen is not None:
            pairs = pairs.join(seen, ["x", "y"], "left_anti")
        done = verify(ws, ws.write(pairs, f"pairs-{number}", small=True), reps, f"likeness-{number}", counts)
        tried = done.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "likeness")
        linked = tried.filter(F.col("likeness") >= threshold).drop("likeness")
        edges = linked if edges is None else edges.unionByName(linked)
        seen = tried.drop("likeness") if seen is None else seen.unionByName(tried.drop("likeness"))
        comp = _labels(ws, comp, connected(ws, edges, f"round-{number}"), f"comp-{number}")
        ws.drop(f"pairs-{number}", *drop)
        drop = [f"comp-{number}"]
    # what is still apart in a band: all pairs of different groups, of which only those with close finer sketches leave the join
    now = buckets.join(comp, "id")
    mixed = now.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi and size > 2")
    apart = ws.write(now.join(mixed.select("band", F.ceil(F.col("size") / 500).cast("int").alias("parts")), "band"), "apart", small=True)
    fine = reps.join(apart.select("id").distinct(), "id", "left_semi").mapInArrow(_fine(counts), schema_of("id long, " + ", ".join(f"{c} long" for c in BITS)))
    left = apart.join(ws.write(fine, "fine"), "id").join(classes.select(F.col("key").alias("id"), "bands"), "id")
    mean = (1 - threshold) * 3 / 4 * FINE
    most = math.ceil(mean + 4.5 * math.sqrt(mean * (1 - mean / FINE)))
    # a large band is dealt into parts by one side of the pairs
    a = left.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("a")
    b = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    once = F.col("a.band") == F.array_min(F.array_intersect("a.bands", "b.bands"))  # of the bands that two texts share, one yields the pair
    half = len(BITS) // 2
    differ = lambda i, j: F.bit_count(F.col(f"a.b{i}").bitwiseXOR(F.col(f"b.b{i}")).bitwiseOR(F.col(f"a.b{j}").bitwiseXOR(F.col(f"b.b{j}"))))
    close = sum((differ(i, i + half) for i in range(1, half)), differ(0, half)) <= most
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.comp") != F.col("b.comp")) & close & once)
    pairs = pairs.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    if seen is not None:
        pairs = pairs.join(seen, ["x", "y"], "left_anti")
    pairs = ws.write(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")), "pairs-rest", small=True)
    ws.drop("apart", "fine", "buckets")
    done = verify(ws, pairs, reps, "likeness-rest", counts)
    linked = done.filter(F.col("likeness") >= threshold).select(F.col("a").alias("x"), F.col("b").alias("y"))
    edges = linked if edges is None else edges.unionByName(linked)
    comp = _labels(ws, comp, connected(ws, edges, "last"), "comp-last")
    links = edges.select(F.explode(F.array("x", "y")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_joining_links"))
    least = classes.select("key", F.col("id").alias("class_id"), "sha").join(comp.select(F.col("id").alias("key"), "comp"), "key")
    lead = least.groupBy("comp").agg(F.min(F.struct("class_id", "sha", "key")).alias("lead"), F.count(F.lit(1)).alias("n"))
    named = spread_join(ws.write(least.select("key", "comp"), "least", small=True), ws.write(lead, "lead", small=True), ["comp"], "n").select("key", F.col("lead.class_id").alias("group_id"), F.col("lead.key").alias("group_key"))
    # a class that shares no band is a group of its own
    named = ws.write(classes.select("key", F.col("id").alias("class_id"), "n").join(named.join(links, "key", "left"), "key", "left").select("key", "n", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("group_key", "key").alias("group_key"), F.coalesce("n_joining_links", F.lit(0)).cast("long").alias("n_joining_links")), "groups", small=True)
    ws.drop("texts", "classes", "fame", "comp-start", *drop, "comp-last", "least", "lead", "pairs-rest", "likeness-rest", *[f"likeness-{i}" for i in range(rounds)], *[f"round-{i}-cc" for i in range(rounds)], "last-cc")
    null = lambda c: F.when(F.col(c) != F.lit(-(2**63)), F.col(c)).alias(c)
    return spread_join(members, named, ["key"], "n").select("doc_id", null("class_id"), null("group_id"), "group_key", "n_joining_links")


def _labels(ws: Workspace, comp: DataFrame, found: DataFrame, name: str) -> DataFrame:
    return ws.write(comp.select("id").join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")), name, small=True)
