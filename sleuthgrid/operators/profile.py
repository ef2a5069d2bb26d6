"""Profiles, histograms and run states."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(v):
    """A string as a number, thousands marks left out; null if it is none."""
    return F.when(F.regexp_replace(v, ",", "").rlike(r"^\s*[+-]?(\d+(_\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.regexp_replace(F.trim(v), "[,_]", "").cast("double"))


def column_profile(df: DataFrame) -> DataFrame:
    """For each column, as strings: total, null_count (blank ones too), null_rate, unique_count, and min, max, mean if over half of the others are numbers, in one pass over the rows."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns])))
    long = long.withColumn("v", F.when(F.trim("v") != "", F.col("v"))).withColumn("x", _number(F.col("v")))
    n, numbers = F.count("v"), F.count("x")
    some = lambda x: F.when(numbers > 0.5 * n, x)
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("total"),
        (F.count(F.lit(1)) - n).alias("null_count"),
        F.round((F.count(F.lit(1)) - n) / F.count(F.lit(1)), 4).alias("null_rate"),
        F.count_distinct("v").alias("unique_count"),
        some(F.min("x")).alias("min"),
        some(F.max("x")).alias("max"),
        some(F.round(F.avg("x"), 4)).alias("mean"),
    )


def top_values(df: DataFrame, most: int = 10) -> DataFrame:
    """column, rank, value, n of the most frequent values of each column that aren't blank, ties by value."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns]))).filter(F.trim("value") != "")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most).select("column", "rank", "value", "n")


#: Ways to write a date that are read as one.
DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX")


def infer_type(df: DataFrame, column: str, order: str) -> DataFrame:
    """column, inferred: null, integer, float, datetime, boolean or string, by a vote of the first 100 values by order that aren't blank.

    All must be whole numbers, or numbers (thousands marks left out), or 15 of
    the first 20 (all, if fewer) dates, or all words for yes and no. Only the
    first rows are sorted out and read.
    """
    c = F.col(f"`{column}`").cast("string")
    first = df.select(c.alias("v"), F.col(f"`{order}`").alias("o")).filter(F.trim("v") != "").orderBy("o").limit(100)
    v = F.regexp_replace("v", ",", "")
    whole = v.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$")
    number = v.rlike(r"(?i)^\s*[+-]?((\d+(_\d+)*\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)\s*$")
    date = F.coalesce(F.try_to_timestamp(F.trim("v")), *[F.try_to_timestamp(F.trim("v"), F.lit(f)) for f in DATE_FORMS]).isNotNull()
    word = F.lower(F.trim("v")).isin("true", "false", "yes", "no", "1", "0", "t", "f", "y", "n")
    votes = first.withColumn("r", F.row_number().over(Window.orderBy("o"))).agg(  # 100 rows
        F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("i"), F.count_if(number).alias("f"), F.count_if(date & (F.col("r") <= 20)).alias("d"), F.count_if(word).alias("b")
    )
    full = lambda x: F.col(x) == F.col("n")
    dated = (F.col("d") >= 15) | (F.col("d") == F.least("n", F.lit(20)))
    kind = F.when(F.col("n") == 0, "null").when(full("i"), "integer").when(full("f"), "float").when(dated, "datetime").when(full("b"), "boolean").otherwise("string")
    return votes.select(F.lit(column).alias("column"), kind.alias("inferred"))


def histogram(events: DataFrame, at: str, kind: str, bucket: str = "day") -> DataFrame:
    """bucket, kind, n of dated rows."""
    form = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[bucket]
    return events.filter(F.col(at).isNotNull()).groupBy(F.date_format(at, form).alias("bucket"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def run_state(events: DataFrame, plan: str, at: str, event: str, tie: str, now: DataFrame, stalled: int = 600, final: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """The state of each plan from its last event: a final one as it is, else running, or stalled if it is older than stalled seconds. now: one row with the time in a column of that name."""
    last = events.groupBy(plan).agg(F.max(F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(event).alias("event"))).alias("last")).crossJoin(F.broadcast(now))
    age = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last.at").cast("timestamp"))
    return last.select(plan, F.when(F.col("last.event").isin(*final), F.col("last.event")).when(age > stalled * 1_000_000, "stalled").otherwise("running").alias("state"), F.col("last.event").alias("last_event"))


def current_run(events: DataFrame, plan: str, order: list[str], event: str, final: tuple[str, ...]) -> DataFrame:
    """Events after the last final one but one: a run's number is how many finals came before it."""
    before = Window.partitionBy(plan).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = events.withColumn("run", F.coalesce(F.sum(F.col(event).isin(*final).cast("int")).over(before), F.lit(0)))
    return numbered.withColumn("_last", F.max("run").over(Window.partitionBy(plan))).filter("run = _last").drop("_last")


def rate_exceeded(requests: DataFrame, client: str, at: str, tie: str, seconds: int, most: int) -> DataFrame:
    """Each request with recent, the accepted ones of its client in the seconds before it, and rejected, if those are most already; rejected ones don't count.

    Whether one is accepted depends on which were before, so a client's requests
    are read in order (at, then tie), with the times of the last most accepted
    ones as all that is held.
    """
    names = [*requests.columns, "recent", "rejected"]
    schema = T.StructType([*requests.schema.fields, T.StructField("recent", T.LongType()), T.StructField("rejected", T.BooleanType())])

    def run(frames):
        last, held = None, deque()
        for frame in frames:
            recent, rejected = [], []
            for who, micros in zip(frame[client].tolist(), frame["_micros"].tolist(), strict=True):
                if who != last:
                    last, held = who, deque()
                while held and micros - held[0] >= seconds * 1_000_000:
                    held.popleft()
                recent.append(len(held))
                rejected.append(len(held) >= most)
                if len(held) < most:
                    held.append(micros)
            yield frame.drop(columns="_micros").assign(recent=recent, rejected=rejected)[names]

    dealt = requests.withColumn("_micros", F.unix_micros(F.col(at).cast("timestamp"))).repartition(client).sortWithinPartitions(client, "_micros", tie)
    return dealt.mapInPandas(run, schema)
