"""What several operators share: tables written between steps, and ordering.

A step's result that is read more than once is written as Parquet under the
folder in ``spark.checkpoint.dir`` and read back; that cuts the lineage and
survives a lost executor. Only where the setting is unset (tests) is a local
folder made.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Settings of a written step. The shuffle files of a finished execution are
#: dropped, so that a chain of steps needs the disk of its largest one and not
#: of all. Only sides that an operator marks are broadcast: it knows their bound.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="sleuthgrid-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


class Workspace:
    """A folder of written tables for one call of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str, small: bool = False) -> DataFrame:
        """Write df once and return it as read back. small: Spark may broadcast sides that it finds under its own threshold."""
        path = f"{self.folder}/{name}"
        was = {c: self.spark.conf.get(c, None) for c in _WRITING}
        for c, value in _WRITING.items():
            if not (small and c.endswith("JoinThreshold")):
                self.spark.conf.set(c, value)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for c, value in was.items():
                self.spark.conf.set(c, value) if value is not None else self.spark.conf.unset(c)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            with contextlib.suppress(Exception):
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def texts(batch, column: str) -> Iterator[bytes]:
    """UTF-8 bytes of each value of an Arrow string column; null is empty."""
    for value in batch.column(column).cast("binary"):
        yield value.as_py() or b""


def released(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """function over Arrow batches, after which the worker hands free memory back, as it lives on and serves other tasks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from function(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, most: int = 1000, least: int = 10_000) -> DataFrame:
    """left joined with right, which has a row for each key and, in n, how many rows of left have it (or more).

    A key with more than 1/most of these rows, of which there can't be more
    than most, is joined by broadcast, so its rows stay where they are; all
    others by merging. left is read twice then and should be a written table.
    """
    size = right.agg(F.sum(n).alias("total"), F.max(n).alias("top")).head()
    limit = max(least, (size["total"] or 0) // most)
    if (size["top"] or 0) <= limit:
        return left.join(right.hint("merge"), keys)
    hot, rest = F.broadcast(right.filter(F.col(n) > limit)), right.filter(F.col(n) <= limit)
    common = left.join(F.broadcast(right.filter(F.col(n) > limit).select(*keys)), keys, "left_anti")
    return common.join(rest.hint("merge"), keys).unionByName(left.join(hot, keys))


def order_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most 1024 values of key, ascending, that cut the rows into runs of about equal size; the first is the smallest."""
    parts = max(1, min(1024, parts))
    row = df.agg(F.min(key).alias("lo"), F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("cuts")).head()
    return [] if row is None or row["lo"] is None else sorted({row["lo"], *(row["cuts"] or [])})


def _bucket(key: Column, bounds: list[int]) -> Column:
    cuts = F.array(*[F.lit(x).cast("long") for x in bounds])
    return F.greatest(F.lit(0), F.size(F.filter(cuts, lambda x: x <= key)) - 1)


def with_next(df: DataFrame, key: str, column: str, alias: str, parts: int, tie: str | None = None) -> DataFrame:
    """Add the value of column in the next row by ascending key; after the last row comes the first.

    Rows are dealt into ranges of the key, and the first row of each range is
    also sent to the range before it, so no task sees more than one range.
    Rows of equal key are ordered by tie (by column if not given); a null key
    sorts first.
    """
    tie = tie or column
    df = df.withColumn("_k", F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))))
    bounds = order_bounds(df, "_k", parts)
    if not bounds:
        return df.withColumn(alias, F.lit(None).cast(df.schema[column].dataType)).drop("_k")
    last = len(bounds) - 1
    first = F.col("_k") == F.lit(bounds[0]).cast("long")
    cuts = F.array(*[F.lit(x).cast("long") for x in bounds[1:]]).cast("array<bigint>")
    copies = F.filter(
        F.array(
            F.struct(_bucket(F.col("_k"), bounds).alias("b"), F.lit(0).alias("g")),
            F.when(F.array_contains(cuts, F.col("_k")), F.struct((_bucket(F.col("_k"), bounds) - 1).alias("b"), F.lit(1).alias("g"))),
            F.when(first, F.struct(F.lit(last).alias("b"), F.lit(2).alias("g"))),
        ),
        lambda x: x.isNotNull(),
    )
    from pyspark.sql import Window

    w = Window.partitionBy("_b").orderBy((F.col("_g") == 2).cast("int"), "_k", tie, "_g")
    dealt = df.withColumn("_c", F.explode(copies)).withColumn("_b", F.col("_c.b")).withColumn("_g", F.col("_c.g")).drop("_c")
    return dealt.withColumn(alias, F.lead(column).over(w)).filter("_g = 0").drop("_k", "_b", "_g")


def schema_of(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # type: ignore[return-value]
