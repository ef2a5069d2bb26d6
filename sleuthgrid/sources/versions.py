"""A table of whole versions, and a keyed cache with expiry on top of it.

A version is a folder of Parquet and a small manifest that names it. The
manifest is written last and moved into place under the next number, which
fails if another writer took it. So readers see whole versions only: what a
writer that was killed has left behind is in no manifest.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[dict]:
        """number, data, label and time (seconds) of every version, the oldest first."""
        at = self._path("_versions")
        if not self._fs.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json"))
        return [json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/_versions/{n}").collect())) for n in names]

    def commit(self, df: DataFrame, label: str = "", at: float | None = None) -> int:
        """Write df as the next version and give its number. Raises if another writer was faster; nothing is seen of df then."""
        data = f"data-{uuid.uuid4().hex}"
        number = (self.versions() or [{"number": 0}])[-1]["number"] + 1
        df.write.parquet(f"{self.folder}/{data}")
        manifest = {"number": number, "data": data, "label": label, "time": time.time() if at is None else at, "schema": df.schema.json()}
        draft, final = self._path(f"_versions/.{uuid.uuid4().hex}"), self._path(f"_versions/{number:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {number} was written by another writer")
        return number

    def read(self, number: int | None = None, as_of: float | None = None) -> DataFrame:
        """The last version, that of a number, or the last one not after a time."""
        found = [v for v in self.versions() if (number is None or v["number"] == number) and (as_of is None or v["time"] <= as_of)]
        if not found:
            raise LookupError("no such version")
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(found[-1]["schema"]))).parquet(f"{self.folder}/{found[-1]['data']}")

    def forget(self, number: int) -> None:
        """Remove a version; others keep their numbers. The last one stays, as numbers go on from it."""
        found = self.versions()
        if not found or number == found[-1]["number"]:
            raise ValueError("the last version stays")
        for v in found:
            if v["number"] == number:
                self._fs.delete(self._path(f"_versions/{number:012d}.json"), False)
                self._fs.delete(self._path(v["data"]), True)


KEY = ("provider", "observable")


def is_fresh(now: Column) -> Column:
    """Without expires_at, or with one after now."""
    return F.col("expires_at").isNull() | (F.col("expires_at") > now)


def latest(rows: DataFrame) -> DataFrame:
    """Of rows of the same key the one fetched last, of these the greatest payload."""
    w = Window.partitionBy(*KEY).orderBy(F.desc_nulls_last("fetched_at"), F.desc("payload"))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def look_up(requests: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Fresh rows of the cache for the requests' different keys, and the keys that have none."""
    keys = requests.select(*KEY).distinct()
    fresh = cache.filter(is_fresh(now))
    return fresh.join(keys, list(KEY), "left_semi"), keys.join(fresh.select(*KEY), list(KEY), "left_anti")


def upsert(table: VersionedTable, rows: DataFrame) -> int:
    """Commit the table with rows in place of older ones of their keys: the row fetched last stays. The first rows make the table."""
    if table.versions():
        rows = table.read().unionByName(rows)
    return table.commit(latest(rows))
