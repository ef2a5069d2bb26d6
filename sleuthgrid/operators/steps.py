"""Tables written between the rounds of an iterative operator."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, in spark.checkpoint.dir; a local one where that is unset on a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="sleuthgrid-steps-")
    return _LOCAL[app]


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df as read back from where it is written, so that plans don't grow and a lost executor costs one round."""
    return _write(df, f"{folder(df.sparkSession)}/step-{uuid.uuid4().hex}")


class Rounds:
    """Written tables that are known by a name; what a name held goes once it has a later table, or at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.now, self.n = spark, f"{folder(spark)}/rounds-{uuid.uuid4().hex}", {}, 0

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        out = _write(df, path)
        self.drop(name)
        self.now[name] = path
        return out

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            if name in self.now:
                path = jvm.org.apache.hadoop.fs.Path(self.now.pop(name))
                with contextlib.suppress(Exception):
                    path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def split_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, most: int = 1000, least: int = 100_000, size: tuple[int, int] | None = None) -> DataFrame:
    """left joined with right, which has one row for each key and in n how many rows of left have it.

    Keys with more than 1/most of these rows, of which there are fewer than
    most, are joined by broadcast and so stay spread; others are dealt by key.
    Both sides are read more than once and should be written tables. size: the
    sum and the greatest of n, if they are known.
    """
    total, top = size or right.agg(F.sum(n), F.max(n)).head()
    limit = max(least, (total or 0) // most)
    if (top or 0) <= limit:
        return left.join(right, keys)
    hot = F.broadcast(right.filter(F.col(n) > limit))
    rest = left.join(F.broadcast(right.filter(F.col(n) > limit).select(*keys)), keys, "left_anti").join(right.filter(F.col(n) <= limit), keys)
    return rest.unionByName(left.join(hot, keys))
