"""Names that mean the same entity."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .network import components
from .steps import cut

#: Types whose names must be equal (fixed values), and those that a part of a name is enough for.
EXACT = ("IPAddress", "Domain", "URL", "EmailAddress", "Hash", "Vulnerability", "TTP")
PARTIAL = ("Person", "ThreatActor", "")


def jaro_winkler(a: str, b: str) -> float:
    """Likeness of two strings by the characters that they share near the same place, and by up to four equal ones at the start if it is over 0.7."""
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])


#: For each number of equal characters at the start (4: or more), the Jaro likeness that a threshold asks for follows from Winkler's rule.
STARTS = range(5)


def _least_jaro(threshold: float, start: int) -> float:
    return (threshold - 0.1 * start) / (1 - 0.1 * start)


def _keys(names: DataFrame, threshold: float) -> DataFrame:
    """name, key: names that could be as like as threshold share a key, whatever they are.

    Of two names, Jaro's m shared characters give m / |a| + m / |b| + 1 >= 3 J,
    so with J at least j the shorter is at least 3 j - 2 of the longer, and they
    share that part of each one's characters, counted with repeats. So if a
    name's characters (each with which of its kind it is) are put in one order,
    the rarest first, two such names share two of the first
    |a| - ceil((3 j - 2) |a|) + 2. Keys are pairs of these, for each length of
    an equal start and with that start; and single ones of names so short that
    one shared character may do.
    """
    marks = names.filter("name <> ''").select("name", F.posexplode(F.split("name", "")).alias("at", "c"))
    turn = F.row_number().over(Window.partitionBy("name", "c").orderBy("at"))  # a name's characters
    marks = marks.filter("c <> ''").withColumn("k", turn).select("name", F.concat("c", F.col("k").cast("string")).alias("mark"))
    often = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    held = marks.join(often, "mark").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "mark"))), lambda x: x["mark"]).alias("marks"))
    keys = []
    for start in STARTS:
        share = 3 * _least_jaro(threshold, start) - 2
        if share <= 0:
            raise ValueError("threshold is too low for this search")
        first = F.slice("marks", 1, (F.size("marks") - F.ceil(F.size("marks") * share - 1e-9) + 2).cast("int"))
        keys.append(F.when(F.length("name") >= start, _with_start(_pairs(first), start)).otherwise(F.array().cast("array<string>")))
        one = F.ceil(F.ceil(F.size("marks") * share - 1e-9) * share - 1e-9) < 2
        keys.append(F.when(one & (F.length("name") >= start), _with_start(F.col("marks"), start)).otherwise(F.array().cast("array<string>")))
    return held.select("name", F.explode(F.concat(*keys)).alias("key"))


def _pairs(first):
    """Every two of an array, joined, in its order."""
    return F.flatten(F.transform(first, lambda x, i: F.transform(F.filter(first, lambda y, j: j > i), lambda y: F.concat(F.least(x, y), F.lit("\x1f"), F.greatest(x, y)))))


def _with_start(pairs, start: int):
    return F.transform(pairs, lambda p: F.concat(F.lit(f"{start}\x1f"), F.substring("name", 1, start), F.lit("\x1f"), p))


def candidates(asked: DataFrame, known: DataFrame, threshold: float, words: bool = True) -> DataFrame:
    """low, other: the different names of asked (low) and known (other) that may be as like as threshold, or (words) of which one may be whole words of the other.

    None is lost: see _keys; and of a name that is whole words of another, the
    longest word is a word of the other (names without letters and digits are
    no words). Equal names are pairs too.
    """
    left, right = cut(asked.select(F.col("low").alias("name")).distinct()), cut(known.select(F.col("other").alias("name")).distinct())
    same = left.join(right, "name").select(F.col("name").alias("low"), F.col("name").alias("other"))
    both = cut(left.unionByName(right).distinct())
    keys = cut(_keys(both, threshold))
    mine = lambda side, c: keys.join(side, "name", "left_semi").select(F.col("name").alias(c), "key", F.length("name").alias(f"n_{c}"))
    short = F.least("n_low", "n_other") / F.greatest("n_low", "n_other") >= 3 * _least_jaro(threshold, 4) - 2 - 1e-9
    out = same.unionByName(mine(left, "low").join(mine(right, "other"), "key").filter(short & (F.col("low") != F.col("other"))).select("low", "other"))
    if words:
        runs = F.filter(F.split("name", r"(?U)[^\w]+"), lambda x: x != "")
        each = lambda side, c: side.select(F.col("name").alias(c), F.explode(F.array_distinct(runs)).alias("word"))
        longest = lambda side, c: side.filter(F.length("name") >= 4).withColumn("w", F.array_sort(F.transform(runs, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))).filter(F.size("w") > 0).select(F.col("name").alias(c), F.col("w")[0]["x"].alias("word"))
        out = out.unionByName(longest(left, "low").join(each(right, "other"), "word").select("low", "other")).unionByName(each(left, "low").join(longest(right, "other"), "word").select("low", "other"))
    return out.distinct()


def _tier(threshold: float, parents: Mapping[str, str] | None):
    """0 (equal), 1 (as like as threshold), 2 (whole words) or null of low with entity_type against other with kind, at score."""
    parent = lambda c: F.coalesce(*[F.when(F.col(c) == k, F.lit(v)) for k, v in (parents or {}).items()], F.lit(None))
    alike = (F.col("entity_type") == "") | (F.col("kind") == "") | (F.col("entity_type") == F.col("kind")) | F.coalesce(parent("entity_type") == parent("kind"), F.lit(False))
    exact = F.col("entity_type").isin(*EXACT)
    short, long = F.when(F.length("low") <= F.length("other"), F.col("low")).otherwise(F.col("other")), F.when(F.length("low") <= F.length("other"), F.col("other")).otherwise(F.col("low"))
    # a whole word: what is before and after it in the longer name isn't a letter, digit or line below
    at = F.instr(long, short)
    edge = lambda c: (c == "") | ~c.rlike(r"(?U)[\w]")
    whole = (at > 0) & edge(F.substring(long, at - 1, 1)) & edge(F.substring(long, at + F.length(short), 1)) | (at == 1) & edge(F.substring(long, 1 + F.length(short), 1))
    part = F.col("entity_type").isin(*PARTIAL) & (F.length(short) >= 4) & whole & (F.length(short) / F.length(long) > 0.3)
    same = F.col("low") == F.col("other")
    return F.when(same & (exact | (alike & ~F.col("kind").isin(*EXACT))), 0).when(exact | F.col("kind").isin(*EXACT), None).when(alike & (F.col("score") >= threshold), 1).when(part, 2)


def resolve(names: DataFrame, existing: DataFrame, threshold: float = 0.92, parents: Mapping[str, str] | None = None) -> DataFrame:
    """name, entity_type, match, rule, score of names (name, entity_type) among existing ones (name, entity_type, position).

    Types in EXACT match equal names alone (rule exact). Other names never match
    one of these, nor one of another type, unless parents names the same parent
    for both or a type is empty. Of the rest an equal name is taken, else the
    likest by Jaro-Winkler if that is threshold or more (rule fuzzy), else, for
    the types in PARTIAL, the first in which the shorter name is a whole word
    (rule part; at least 4 characters and over three tenths of the longer).
    Names compare without case and outer space; of ties the lowest position.

    Different names are compared once, and only those that may be alike; no
    pair over the threshold is lost (see candidates).
    """
    clean = lambda c: F.lower(F.trim(c))
    asked = names.select("name", F.coalesce("entity_type", F.lit("")).alias("entity_type")).distinct().withColumn("low", clean(F.col("name")))
    known = existing.select(F.col("name").alias("match"), F.coalesce("entity_type", F.lit("")).alias("kind"), "position", clean(F.col("name")).alias("other"))
    pairs = cut(candidates(asked, known, threshold)).withColumn("score", F.when(F.col("low") == F.col("other"), 1.0).otherwise(_likeness("low", "other")))
    tier = _tier(threshold, parents)
    rated = asked.join(pairs, "low").join(known, "other").withColumn("tier", tier).filter("tier is not null")
    best = F.min_by(F.struct("match", "tier", "score"), F.struct("tier", F.when(F.col("tier") == 1, -F.col("score")).otherwise(0.0), "position"))
    found = rated.groupBy("name", "entity_type").agg(best.alias("b"))
    rule = F.element_at(F.array(F.lit("exact"), F.lit("fuzzy"), F.lit("part")), F.col("b.tier") + 1)
    return asked.drop("low").join(found.select("name", "entity_type", F.col("b.match").alias("match"), rule.alias("rule"), F.col("b.score").alias("score")), ["name", "entity_type"], "left")


def merge_batch(batch: DataFrame, graph: DataFrame, threshold: float = 0.92, parents: Mapping[str, str] | None = None) -> DataFrame:
    """position, name, entity_type, outcome, entity of a batch of extracted entities (position, name, entity_type, filtered, absorbed).

    outcome is filtered (junk, as filtered says), absorbed or orphaned (dates,
    by absorbed), merged, or created. Names of the batch that match one another
    by resolve are one entity, however far apart in the batch, and so is
    whatever matches one of them: unlike a pass in order of arrival, the result
    doesn't depend on it. A group of names that an entity of the graph (name,
    entity_type, position, id) matches is that entity (of several the lowest
    position); else its first row is created as new:<position> and the others
    merge into it.
    """
    rows = cut(batch.withColumn("outcome", F.when(F.col("filtered"), "filtered").when(F.col("entity_type") == "Date", F.when(F.col("absorbed"), "absorbed").otherwise("orphaned"))).withColumn("kind", F.coalesce("entity_type", F.lit(""))))
    open_ = rows.filter("outcome is null")
    keys = open_.groupBy("name", "kind").agg(F.min("position").alias("position"))
    keys = cut(keys.withColumn("id", F.col("position").cast("string")))
    # within the batch a name resolves against all earlier ones, best or not: any match ties the two
    ties = _ties(keys, threshold, parents)
    groups = components(ties, keys.select("id")).join(keys, "id")
    known = resolve(keys.select("name", F.col("kind").alias("entity_type")), graph.select("name", "entity_type", "position"), threshold, parents).filter("match is not null")
    there = graph.select(F.col("name").alias("match"), F.col("id").alias("entity"), F.col("position").alias("at"))
    first_there = there.groupBy("match").agg(F.min(F.struct("at", "entity")).alias("e"))
    hits = known.select("name", F.col("entity_type").alias("kind"), "match").join(first_there, "match").select("name", "kind", "e")
    each = cut(groups.join(hits, ["name", "kind"], "left"))
    homes = each.groupBy("comp").agg(F.min("e").alias("e"), F.min("position").alias("first"))
    placed = each.drop("e", "position").join(homes, "comp").select("name", "kind", F.col("e.entity").alias("found"), "first")
    out = open_.drop("outcome").join(placed, ["name", "kind"])
    new = F.concat(F.lit("new:"), F.col("first").cast("string"))
    out = out.select("position", "name", "entity_type", F.when(F.col("found").isNull() & (F.col("position") == F.col("first")), "created").otherwise("merged").alias("outcome"), F.coalesce("found", new).alias("entity"))
    return out.unionByName(rows.filter("outcome is not null").select("position", "name", "entity_type", "outcome", F.lit(None).cast("string").alias("entity")))


def _ties(keys: DataFrame, threshold: float, parents: Mapping[str, str] | None) -> DataFrame:
    """source_id, target_id of names of a batch that match one another by the rules of resolve."""
    low = F.lower(F.trim("name"))
    k = keys.withColumn("low", low)
    pairs = cut(candidates(k, k.select(F.col("low").alias("other")), threshold)).withColumn("score", F.when(F.col("low") == F.col("other"), 1.0).otherwise(_likeness("low", "other")))
    a = k.select(F.col("id").alias("source_id"), F.col("kind").alias("entity_type"), "low")
    b = k.select(F.col("id").alias("target_id"), "kind", F.col("low").alias("other"))
    rated = a.join(pairs, "low").join(b, "other").withColumn("tier", _tier(threshold, parents))
    return rated.filter("tier is not null and source_id <> target_id").select("source_id", "target_id")


def counters(merged: DataFrame) -> DataFrame:
    """created, merged, filtered, absorbed, orphaned: how many rows of a merged batch had each outcome."""
    return merged.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "merged", "filtered", "absorbed", "orphaned")])


def place_edges(relationships: DataFrame, merged: DataFrame, least: float = 0.6) -> DataFrame:
    """relationships (source_name, target_name, rel_type, confidence) with source, target (entities of merged) and fate.

    fate: stored; retired (OCCURRED_ON whose date was taken in); dropped (an end
    that isn't an entity); weak (ASSOCIATED_WITH under least). Of several
    entities of a name the one of the last position counts.
    """
    ends = merged.groupBy("name").agg(F.max_by("entity", F.when(F.col("entity").isNotNull(), F.col("position"))).alias("entity"), F.max(F.col("outcome").isin("absorbed", "orphaned")).alias("date"))
    side = lambda c: ends.select(F.col("name").alias(f"{c}_name"), F.col("entity").alias(c), F.col("date").alias(f"{c}_date"))
    both = relationships.join(side("source"), "source_name", "left").join(side("target"), "target_name", "left")
    dated = F.coalesce("source_date", F.lit(False)) | F.coalesce("target_date", F.lit(False))
    fate = F.when(F.col("source").isNotNull() & F.col("target").isNotNull(), F.when((F.col("rel_type") == "ASSOCIATED_WITH") & (F.coalesce("confidence", F.lit(0.5)) < least), "weak").otherwise("stored")).when((F.col("rel_type") == "OCCURRED_ON") & dated, "retired").otherwise("dropped")
    return both.select(*relationships.columns, "source", "target", fate.alias("fate"))
