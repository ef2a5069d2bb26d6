"""Indicators in texts: addresses, domains, links, mail addresses, hashes, codes and dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import OCTET, refang

# fixed values: kinds in the order in which they are looked for, their patterns and confidence; what is seen under one kind isn't given under a later one
MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
#: Endings of domains unless others are given: common generic ones, and countries of the most hosts.
ENDINGS = tuple(
    """com org net io gov mil edu info onion biz app dev cloud online site store shop blog xyz top club live news media tech digital agency systems network
    host space website email link page pro mobi name aero coop museum jobs travel int arpa
    ac ad ae af ag ai al am ar as at au az ba bb bd be bg bh bn bo br bs bt bw by bz ca cc cd ch ci cl cm cn co cr cu cv cy cz de dj dk do dz ec ee eg es et eu
    fi fj fm fo fr ga ge gf gg gh gl gm gp gr gt gy hk hn hr ht hu id ie il im in iq ir is it je jm jo jp ke kg kh kp kr kw ky kz la lb lc li lk ls lt lu lv ly
    ma mc md me mg mk ml mm mn mo mr mt mu mv mw mx my mz na nc ne ng ni nl no np nz om pa pe pf pg ph pk pl pm pr ps pt pw py qa re ro rs ru rw sa sb sc sd se
    sg sh si sk sl sm sn so sr st su sv sx sy sz tc td tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vn vu ws ye za zm zw""".split()
)
KINDS = (
    ("IPAddress", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.95),
    ("Domain", r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+(?:ENDINGS)\b", 0.9),
    ("URL", r"""(?i)https?://[^\s<>"')\]}]+""", 0.9),
    ("EmailAddress", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", 0.9),
    ("Hash", r"\b(?:[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b", 0.6),
    ("Vulnerability", r"\bCVE-\d{4}-\d{4,}\b", 0.95),
    ("TTP", r"\bT\d{4}(?:\.\d{3})?\b", 0.9),
    ("EquipmentType", r"\bType[- ]?\d{2,4}[A-Z]?\b", 0.85),
    ("Date", rf"\b{MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b|\b{MONTH}\s+\d{{4}}\b|\b\d{{4}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b|\bQ[1-4]\s+\d{{4}}\b", 0.95),
)
ABOUT_HASHES = r"(?i)\b(?:hash|md5|sha1|sha256|sha-1|sha-256|checksum|ioc|indicator|malware|sample|binary|payload|artifact)\b"


def indicators(docs: DataFrame, key: str, text: str = "text", endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """key, name, entity_type, confidence: every indicator of a text once, after refanging.

    Addresses with a number over 255 aren't any; domains, mail addresses and
    hashes are in lower case; links lose punctuation at their end; a domain
    behind a percent sign loses the code that belongs to it. A hash is surer
    (by 0.3, or 0.25 for one of 64 digits) if a word about hashes is within 200
    characters. The 32 digits of a UUID that the text holds are no hash. A name
    that several kinds match has the first of them. endings: those of domains.
    """
    base = docs.select(key, refang(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("t"))
    ends = F.split(F.concat(F.lit(" "), "t"), "%")  # what follows a percent sign, where a domain may begin with a code

    def found(kind: str, pattern: str, sure: float) -> DataFrame:
        if kind == "Hash":
            rows = base.filter(F.col("t").rlike(pattern)).select(key, F.col("t"), F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(f"({pattern})"), 1))).alias("raw"))
            ids = F.transform(F.regexp_extract_all("t", F.lit(UUID), 0), lambda u: F.lower(F.replace(u, F.lit("-"), F.lit(""))))
            rows = rows.filter((F.length("raw") != 32) | ~F.array_contains(ids, F.lower("raw")))
            at = F.instr(F.col("t"), F.col("raw"))
            window = F.substring(F.col("t"), F.greatest(F.lit(1), at - 200), F.length("raw") + 200 + F.least(F.lit(200), at - 1))
            bonus = F.when(window.rlike(ABOUT_HASHES), F.when(F.length("raw") == 64, 0.25).otherwise(0.3)).otherwise(0.0)
            return rows.select(key, F.lower("raw").alias("name"), F.lit(kind).alias("entity_type"), F.round(F.when(F.length("raw") == 64, 0.7).otherwise(sure) + bonus, 2).alias("confidence"))
        if kind == "Domain":
            pattern = pattern.replace("ENDINGS", "|".join(sorted(endings, key=lambda e: (-len(e), e))))
            parts = F.transform(ends, lambda p, i: F.when(i > 0, F.regexp_replace(p, "(?i)^(?:25)*[0-9a-f]{2}(?=[a-z])", "")).otherwise(p))
            dotted = lambda p: F.array_join(F.filter(F.split(p, r"\s+"), lambda w: F.contains(w, F.lit("."))), " ")
            names = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(dotted(p), F.lit(f"({pattern})"), 1)))
            return base.select(key, F.explode(F.transform(names, F.lower)).alias("name"), F.lit(kind).alias("entity_type"), F.lit(sure).alias("confidence"))
        rows = base.select(key, F.explode(F.regexp_extract_all("t", F.lit(f"({pattern})"), 1)).alias("name"))
        if kind == "IPAddress":
            rows = rows.filter(F.col("name").rlike(rf"^({OCTET}\.){{3}}{OCTET}$"))
        elif kind == "URL":
            rows = rows.withColumn("name", F.regexp_replace("name", r"""[.,;:!?)\]}'"]+$""", ""))
        elif kind == "EmailAddress":
            rows = rows.withColumn("name", F.lower("name"))
        return rows.select(key, "name", F.lit(kind).alias("entity_type"), F.lit(sure).alias("confidence"))

    every = reduce(lambda a, b: a.unionByName(b), [found(*k).withColumn("_order", F.lit(i)) for i, k in enumerate(KINDS)])
    best = F.min_by(F.struct("entity_type", "confidence"), F.struct("_order", -F.col("confidence")))
    return every.filter("name <> ''").groupBy(key, "name").agg(best.alias("e")).select(key, "name", "e.entity_type", "e.confidence")
