"""Collection plans, requirements, timelines and project figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project_counts(projects: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """id, n_entities, n_documents, n_edges of every project (id): entities (id, project_id, entity_type) but projects, and edges with both ends in the same project; 0 where there are none."""
    mine = entities.filter("entity_type <> 'Project'").groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("entity_type") == "Document").alias("n_documents"))
    end = lambda c: entities.select(F.col("id").alias(c), F.col("project_id").alias(f"{c}_project"))
    inside = edges.join(end("source_id"), "source_id").join(end("target_id"), "target_id").filter("source_id_project = target_id_project")
    links = inside.groupBy(F.col("source_id_project").alias("id")).agg(F.count(F.lit(1)).alias("n_edges"))
    return projects.select("id").join(mine, "id", "left").join(links, "id", "left").fillna(0, ["n_entities", "n_documents", "n_edges"])


def source_health(acquisitions: DataFrame) -> DataFrame:
    """source, attempts, succeeded, failed, records, last_success of acquisitions (source, ok, records, at)."""
    return acquisitions.groupBy("source").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("records"))), F.lit(0)).alias("records"),
        F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"),
    )


def roll_up(requirements: DataFrame, key: str = "pir_id") -> DataFrame:
    """The status of each set of requirements (key, status; null is UNASSESSED): SATISFIED if all are, PARTIAL if any is or is partial, else OPEN; and how many are pending, satisfied and unmet."""
    status = F.upper(F.coalesce("status", F.lit("UNASSESSED")))
    good, some = status == "SATISFIED", status.isin("SATISFIED", "PARTIAL")
    out = F.when(F.every(good), "SATISFIED").when(F.bool_or(some), "PARTIAL").otherwise("OPEN")
    return requirements.groupBy(key).agg(out.alias("status"), F.count_if(good).alias("n_satisfied"), F.count_if(status == "UNMET").alias("n_unmet"), F.count_if(~status.isin("SATISFIED", "UNMET")).alias("n_pending"))


def reconcile(stored: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, state, action of requirements stored (keys, text, state) against wanted ones (keys, text).

    New ones are inserted as pending; a changed text resets the state to
    pending; one that isn't wanted any more is deleted; others are kept.
    """
    both = stored.select(*keys, F.col("text").alias("old"), "state", F.lit(True).alias("had")).join(wanted.select(*keys, F.col("text").alias("new"), F.lit(True).alias("wants")), keys, "full")
    action = F.when(F.col("had").isNull(), "insert").when(F.col("wants").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "reset").otherwise("keep")
    return both.select(*keys, F.when(F.col("wants"), F.col("new")).otherwise(F.col("old")).alias("text"), F.when(action.isin("insert", "reset"), "pending").otherwise(F.col("state")).alias("state"), action.alias("action"))


def latest(df: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The first most rows of each key by order, with their rank; Spark keeps no more than most a key and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= most)


def timeline(entities: DataFrame, most: int = 500) -> DataFrame:
    """id, name, at, kind of the first most entities by name (then id), latest first: the time of an event, or else when the entity was created."""
    first = entities.orderBy("name", "id").limit(most)
    at = F.coalesce("event_at", "created_at")
    return first.select("id", "name", at.alias("at"), F.when(F.col("event_at").isNotNull(), "event").otherwise("entity_created").alias("kind")).orderBy(F.desc("at"), "id")


def entity_timeline(entities: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """id, at, kind: when entities (id, created_at, event_at) were created and happened, when their edges (source_id, target_id, seen) were first seen, and the dates of documents (id, at) that mention them."""
    part = lambda df, c, kind: df.filter(F.col(c).isNotNull()).select("id", F.col(c).alias("at"), F.lit(kind).alias("kind"))
    ends = edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"), "seen")
    return part(entities, "created_at", "created").unionByName(part(entities, "event_at", "event")).unionByName(part(ends, "seen", "relationship")).unionByName(part(mentions, "at", "document"))


def daily(rows: DataFrame, at: str = "at") -> DataFrame:
    """id, day, n, with the first and last time of all of the id's rows."""
    counts = rows.groupBy("id", F.date_format(at, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    ends = counts.groupBy("id").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    return counts.select("id", "day", "n").join(ends, "id")


def source_reserve(limit: Column) -> tuple[Column, Column]:
    """Of a limit of sources, how many are kept back for later passes (three tenths, 1 at least), and how many are planned."""
    reserve = F.greatest(F.lit(1), F.floor(limit * 0.3))
    return reserve, F.greatest(F.lit(1), limit - reserve)


def fair_share(remaining: Column, open_elements: Column) -> Column:
    """What each open element may use of a remaining budget: an equal part, 1 at least."""
    return F.greatest(F.lit(1), F.floor(remaining / F.greatest(F.lit(1), open_elements)))


def pack_skipping(df: DataFrame, key: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """key, n, used: rows are taken in order as long as they fit a budget; one that doesn't is passed over and later ones may still fit.

    It is a fold over the sizes of a key's candidates, which a retrieval has
    limited before; they are the only thing that is gathered.
    """
    sizes = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(size).cast("long").alias("_size")))), lambda x: x["_size"])
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("used"))
    fits = lambda acc, x: acc["used"] + x <= budget
    fold = F.aggregate(sizes, start, lambda acc, x: F.struct((acc["n"] + fits(acc, x).cast("long")).alias("n"), (acc["used"] + F.when(fits(acc, x), x).otherwise(0)).alias("used")))
    return df.groupBy(*key).agg(fold.alias("packed")).select(*key, "packed.n", "packed.used")


def by_name(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges between names (source_name, target_name) with the ids of their ends by name without case (of equal names the smallest id); resolved is false if either is unknown."""
    names = entities.groupBy(F.lower(F.trim("name")).alias("_name")).agg(F.min("id").alias("_id"))
    out = edges
    for end in ("source", "target"):
        out = out.join(names.select(F.col("_name").alias(f"_{end}"), F.col("_id").alias(f"{end}_id")), F.lower(F.trim(F.col(f"{end}_name"))) == F.col(f"_{end}"), "left").drop(f"_{end}")
    return out.withColumn("resolved", F.col("source_id").isNotNull() & F.col("target_id").isNotNull())


def merge_entities(primary: DataFrame, other: DataFrame) -> DataFrame:
    """Entities (name, entity_type, confidence) of two extractions, once for each name without case: the primary's where it has one, and the most confident of the rest."""
    rows = primary.withColumn("_rank", F.lit(0)).unionByName(other.withColumn("_rank", F.lit(1)))
    best = F.min_by(F.struct("name", "entity_type", "confidence"), F.struct("_rank", -F.col("confidence"), "name", "entity_type"))
    return rows.groupBy(F.lower(F.trim("name")).alias("_key")).agg(best.alias("e"), F.count_distinct("_rank").alias("n_methods")).select("e.*", "n_methods")
