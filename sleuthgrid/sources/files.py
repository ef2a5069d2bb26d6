"""Readers of text formats, into rows with a number and typed where asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension to format (fixed values); geojson stands before json.
FORMATS = {"csv": "csv", "tsv": "csv", "xlsx": "excel", "xls": "excel", "jsonl": "jsonl", "geojson": "geojson", "json": "json", "xml": "xml", "kml": "xml", "rss": "xml", "atom": "xml"}
DELIMITERS = (",", "\t", ";", "|")


def detect_format(name: str) -> str | None:
    return FORMATS.get(name.rpartition(".")[2].lower())


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that cuts the first lines into the same number of fields, over one; the most fields win, then the first listed."""
    best, most = DELIMITERS[0], 1
    for d in DELIMITERS:
        counts = {line.count(d) + 1 for line in lines if line.strip()}
        if len(counts) == 1 and (n := counts.pop()) > most:
            best, most = d, n
    return best


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Columns as strings and _row_number from 1 in file order; short rows end in nulls. The delimiter is sniffed from ten lines if not given."""
    if delimiter is None:
        delimiter = sniff_delimiter([r.value for r in spark.read.text(path).limit(10).collect()])
    df = spark.read.csv(path, sep=delimiter, header=header, encoding=encoding, mode="PERMISSIVE")
    # partition offsets from one count for each partition: no global sort
    part = df.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    counts = part.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    from pyspark.sql import Window

    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    joined = part.join(F.broadcast(offsets), "_part")  # a row for each partition
    return joined.withColumn("_row_number", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_before")


def read_json(spark: SparkSession, path: str, lines: bool = False, records_path: str | None = None) -> DataFrame:
    """Records of JSON lines (bad ones are skipped), of an array, or of the array at a dotted path."""
    if lines:
        return spark.read.json(path, mode="DROPMALFORMED")
    df = spark.read.json(path, multiLine=True)
    return df.select(F.explode(records_path).alias("_r")).select("_r.*") if records_path else df


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """One row for each element of the tag; attributes have names with @."""
    return spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@").load(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Properties of each feature as columns, and latitude, longitude (mean vertex), bbox and vertex_count of its geometry; null without one."""
    raw = spark.read.text(path, wholetext=True)
    feature = "array<struct<properties:map<string,string>,geometry:string>>"
    f = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), feature)).alias("f")).select("f.properties", F.col("f.geometry").alias("g"))
    pairs = F.regexp_extract_all(F.get_json_object("g", "$.coordinates"), F.lit(r"\[\s*(-?[0-9.eE+-]+\s*,\s*-?[0-9.eE+-]+)"), 1)
    xy = F.transform(pairs, lambda p: F.transform(F.split(p, ","), lambda v: F.trim(v).cast("double")))
    f = f.withColumn("xy", F.when(F.col("g").isNotNull(), xy))
    axis = lambda i: F.transform("xy", lambda p: p[i])
    mean = lambda i: F.round(F.aggregate(axis(i), F.lit(0.0), lambda s, v: s + v) / F.size("xy"), 6)
    return f.select("properties", mean(1).alias("latitude"), mean(0).alias("longitude"), F.when(F.size("xy") > 0, F.struct(F.array_min(axis(1)).alias("min_lat"), F.array_min(axis(0)).alias("min_lng"), F.array_max(axis(1)).alias("max_lat"), F.array_max(axis(0)).alias("max_lng"))).alias("bbox"), F.when(F.col("xy").isNotNull(), F.size("xy")).alias("vertex_count"))
