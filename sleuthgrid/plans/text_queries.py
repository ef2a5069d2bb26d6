"""Queries of the text, page and indicator functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunks as ch
from ..functions import coordinates as geo
from ..functions import indicators as ind
from ..functions import quality as ql
from ..functions import text as tx
from ..operators import evaluation as ev
from .catalog import query
from .model import table

_MARKED = """concat(CASE doc_id % 5 WHEN 0 THEN '## ' WHEN 1 THEN '> ' WHEN 2 THEN '://x.y/z "T"). ' ELSE '' END, lang, ' [[', doc_id % 50, ']](http://x.y/#c) ![', source, '](http://x.y "t") **b** __c__ [[edit](u)] _it is_ snake_case_name', CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), chr(10), chr(10), chr(10), '### h', chr(10), '[cut](http://x.y') ELSE '' END, chr(10), replace(text, ', ', ',  '))"""


def _marked(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_MARKED).alias("text"))


_STRIPPED = _MARKED
for _pattern, _put in (
    (r"\[\[\d+\]\]\([^)]*\)", ""),
    (r"(?i)\[?\[\s*edit\s*\]\([^)]*\)\]?", ""),
    (r"!?\[([^\]]*)\]\([^)]*\)", r"\1"),
    (r"(?m)!?\[([^\]]*)\]\([^)\s]*$", r"\1"),
    (r"(?m)^[ \t]*(?:#{1,6}|>+)[ \t]*", ""),
    (r"\*\*|__", ""),
    (r"([^A-Za-z0-9_])_([^_\n]{1,80})_([^A-Za-z0-9_])", r"\1\2\3"),
    (r"\A://\S*(?:\s+\"[^\"]*\")?\)?[.,;:]?[ \t]*", ""),
    (r"[ \t]{2,}", " "),
    (r"\n{3,}", "\n\n"),
    (r"\A\s+|\s+\z", ""),
):
    _put_sql = "concat(chr(10), chr(10))" if _put == "\n\n" else f"'{_put}'"
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_pattern}', {_put_sql}, 'g')"


@query("f4_markup", f"SELECT doc_id, md5(t) AS stripped, length(t) AS n FROM (SELECT doc_id, {_STRIPPED} AS t FROM documents)")
def f4(spark, d):
    plain = _marked(spark, d).select("doc_id", tx.strip_markup(F.col("text")).alias("t"))
    return plain.select("doc_id", F.md5("t").alias("stripped"), F.length("t").cast("long").alias("n"))


_NAME = "CASE p_partkey % 8 WHEN 0 THEN concat('## ', p_name) WHEN 1 THEN concat('**', p_name, '**') WHEN 2 THEN concat('[', p_name, '](http://x.y)') WHEN 3 THEN concat(p_name, ' (', p_brand, ')](http://x') WHEN 4 THEN concat(p_name, ']') WHEN 5 THEN concat('- 1. [', p_name) WHEN 6 THEN concat('\"', p_name, '\" ') ELSE concat('_', p_name, '*') END"


@query("f5_names", "SELECT p_partkey, CASE WHEN p_partkey % 8 = 3 THEN p_name || ' (' || p_brand || ')' ELSE p_name END AS name FROM part")
def f5(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.clean_name(F.expr(_NAME)).alias("name"))


@query("f8_sentences", r"""SELECT doc_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n{2,}', chr(1), 'g'), chr(1))), chr(9) || chr(10) || chr(13) || ' ') AS s FROM documents) WHERE length(s) >= 20 GROUP BY 1""")
def f8(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("n_chars"))


@query("l6_passages")
def l6(spark, d):
    found = tx.passages(F.col("text"), ["the", "en", "er", "ich"], most=3, most_chars=600)
    return table(spark, d, "documents").select("doc_id", F.posexplode(found).alias("rank", "p")).select("doc_id", "rank", "p.text", "p.score")


@query("f9_chunks")
def f9(spark, d):
    plain = _marked(spark, d).select("doc_id", tx.strip_markup(F.col("text")).alias("t"))
    return plain.select("doc_id", F.posexplode(ch.chunks(F.col("t"))).alias("chunk_index", "content"))


_SENTENCE = "concat('  ', text, ' ', lang, '  is from ', source)"


@query(
    "f14_evidence",
    rf"""WITH s AS (SELECT doc_id, lang AS a, CASE WHEN doc_id % 3 = 0 THEN 'nowhere' ELSE upper(source) END AS b, trim(regexp_replace({_SENTENCE}, '\s+', ' ', 'g')) AS s FROM documents WHERE text IS NOT NULL), i AS (SELECT *, instr(lower(s), lower(a)) AS ia, instr(lower(s), lower(b)) AS ib FROM s),
    w AS (SELECT *, greatest(0, least(ia, ib) - 46) AS lo, least(length(s), greatest(ia - 1 + length(a), ib - 1 + length(b)) + 45) AS hi FROM i)
    SELECT doc_id, md5(CASE WHEN ia > 0 AND ib > 0 THEN CASE WHEN lo > 0 THEN '...' ELSE '' END || substr(s, lo + 1, hi - lo) || CASE WHEN hi < length(s) THEN '...' ELSE '' END WHEN length(s) > 300 THEN substr(s, 1, 300) || '...' ELSE s END) AS evidence FROM w""",
)
def f14(spark, d):
    b = F.when(F.col("doc_id") % 3 == 0, "nowhere").otherwise(F.upper("source"))
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(tx.evidence(F.expr(_SENTENCE), F.col("lang"), b)).alias("evidence"))


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_LINK = f"CASE page_id % 9 WHEN 0 THEN concat('https://WWW.X.com/', page_id) WHEN 1 THEN concat('http://citrix.com/', page_id) WHEN 2 THEN concat('https://cdn.', {_HOST}, '/a') WHEN 3 THEN concat(url, '.PNG?x=1') WHEN 4 THEN concat('m.facebook.com') WHEN 5 THEN {_HOST} WHEN 6 THEN 'images.x.org/y' WHEN 7 THEN 'assets-2.z.net' ELSE url END"


@query(
    "p10_web_chrome",
    rf"""WITH l AS (SELECT page_id, lower({_LINK}) AS u FROM pages), h AS (SELECT page_id, u, regexp_replace(regexp_extract(u, '^(?:https?://)?([^/?#:]*)', 1), '^www\.', '') AS h FROM l)
    SELECT page_id, page_id % 7 <> 0 AND (list_has_any([h, regexp_replace(h, '^[^.]*\.', '')], [{", ".join(f"'{x}'" for x in ql.SOCIAL)}]) OR regexp_matches(h, '^(cdn|assets?|static|img)[.-]|^images\.')
    OR regexp_matches(regexp_replace(u, '[?#].*$', ''), '\.(jpg|jpeg|png|gif|webp|svg|ico|bmp|css|js|mjs|map|woff|woff2|ttf|eot|mp4|webm|mp3|m3u8)$')) AS chrome FROM h""",
)
def p10(spark, d):
    kind = F.when(F.col("page_id") % 7 == 0, "Organization").otherwise("URL")
    return table(spark, d, "pages").select("page_id", ql.web_chrome(F.expr(_LINK), kind).alias("chrome"))


_DOMAIN = f"CASE page_id % 8 WHEN 0 THEN '.gov' WHEN 1 THEN 'a.org' WHEN 2 THEN concat('2fen.', {_HOST}, '.org') WHEN 3 THEN '2fa.com' WHEN 4 THEN 'host' WHEN 5 THEN ' Example.Org ' WHEN 6 THEN url ELSE {_HOST} END"


@query(
    "p11_malformed_hosts",
    rf"""SELECT page_id, v NOT LIKE 'http%' AND (v NOT LIKE '%.%' OR v LIKE '.%' OR length(split_part(v, '.', 1)) < 2 OR regexp_matches(v, '^(2f|3a|3d|25|20)[a-z0-9-]*\.[^.]*\.')) AS malformed FROM (SELECT page_id, trim(lower({_DOMAIN})) AS v FROM pages)""",
)
def p11(spark, d):
    return table(spark, d, "pages").select("page_id", ql.malformed_host(F.expr(_DOMAIN), F.lit("Domain")).alias("malformed"))


_PAGE = "CASE doc_id % 10 WHEN 0 THEN concat('Just a moment ', text) WHEN 1 THEN concat('Please SIGN IN to continue. ', text) WHEN 2 THEN 'few words here' WHEN 3 THEN concat(text, ' captcha') ELSE text END"
_AT = "CASE WHEN doc_id % 11 = 0 THEN concat('https://x.y/Login?next=', doc_id) WHEN doc_id % 11 = 1 THEN 'https://x.y/logins' ELSE 'https://x.y/a' END"
_TITLE = "CASE WHEN doc_id % 13 = 0 THEN ' Are you HUMAN? ' ELSE 'A title' END"


@query(
    "p12_page_quality",
    rf"""WITH p AS (SELECT doc_id, {_AT} AS u, {_TITLE} AS title, coalesce({_PAGE}, '') AS c FROM documents), q AS (SELECT *, lower(substr(c, 1, 1500)) AS head, len(list_filter(regexp_split_to_array(c, '\s+'), lambda x: x <> '')) AS n FROM p)
    SELECT doc_id, CASE WHEN regexp_matches(u, '{ql.AUTH_PATH}') THEN 'login or paywall page' {" ".join(f"WHEN contains(head, '{x}') THEN 'paywalled content ({x})'" for x in ql.PAYWALL)}
    {" ".join(f"WHEN contains(lower(title), '{x}') OR contains(head, '{x}') AND n < 200 THEN 'anti-bot or interstitial page ({x})'" for x in ql.BLOCKED)} WHEN n < 60 THEN 'only ' || n || ' words of content' ELSE '' END AS reason FROM q""",
)
def p12(spark, d):
    return table(spark, d, "documents").select("doc_id", ql.rejection_reason(F.expr(_AT), F.expr(_PAGE), F.expr(_TITLE)).alias("reason"))


_TYPED_NAME = "CASE p_partkey % 5 WHEN 0 THEN concat('MV ', p_name) WHEN 1 THEN concat('mq-', p_partkey % 10, ' ', p_name) WHEN 2 THEN concat('M/T', p_name) WHEN 3 THEN concat('USS  ', p_name) ELSE p_name END"
_TYPE = "CASE WHEN p_partkey % 7 = 0 THEN 'Location' WHEN p_partkey % 7 = 1 THEN 'Custom' ELSE 'Product' END"


@query("f15_type_hints", f"SELECT p_partkey, CASE WHEN {_TYPE} = 'Location' THEN 'Location' WHEN p_partkey % 5 IN (0, 3) THEN 'Ship' WHEN p_partkey % 5 = 1 THEN 'Drone' ELSE {_TYPE} END AS kind FROM part")
def f15(spark, d):
    return table(spark, d, "part").select("p_partkey", ql.type_hint(F.expr(_TYPED_NAME), F.expr(_TYPE)).alias("kind"))


_SEEN = """concat(text, ' CVE-2024-', 1000 + doc_id % 50, ' CVE-2024-', 1000 + doc_id % 50, ' T1', 100 + doc_id % 30, '.00', doc_id % 10, ' Type 0', doc_id % 90 + 10, 'D on Q', doc_id % 4 + 1, ' 2024, May ', doc_id % 28 + 1, ', 2023 and 2024-02-1', doc_id % 10, ' at 999.1.1.1 or 8.8.', doc_id % 200, '.4 by Host', doc_id % 9, '.Example.co, https://x', doc_id % 7, '.example.jp/a; User', doc_id % 5, '@mail.example.in with ', md5(cast(doc_id % 40 AS string)), ' hash')"""


_ENDINGS = "|".join(sorted(ind.ENDINGS, key=lambda e: (-len(e), e)))


@query(
    "f13_indicators",
    rf"""WITH t AS (SELECT doc_id, {_SEEN} AS t FROM documents WHERE text IS NOT NULL), w AS (
    SELECT doc_id, unnest(regexp_extract_all(t, '\bCVE-\d{{4}}-\d{{4,}}\b')) AS name, 'Vulnerability' AS entity_type, 0.95 AS confidence FROM t
    UNION ALL SELECT doc_id, unnest(regexp_extract_all(t, '\bT\d{{4}}(?:\.\d{{3}})?\b')), 'TTP', 0.9 FROM t UNION ALL SELECT doc_id, unnest(regexp_extract_all(t, '\bType[- ]?\d{{2,4}}[A-Z]?\b')), 'EquipmentType', 0.85 FROM t
    UNION ALL SELECT doc_id, unnest(regexp_extract_all(t, '\b{ind.MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b|\b{ind.MONTH}\s+\d{{4}}\b|\b\d{{4}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b|\bQ[1-4]\s+\d{{4}}\b')), 'Date', 0.95 FROM t
    UNION ALL SELECT doc_id, lower(unnest(regexp_extract_all(t, '\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\.)+(?:{_ENDINGS})\b'))), 'Domain', 0.9 FROM t
    UNION ALL SELECT doc_id, rtrim(unnest(regexp_extract_all(t, '(?i)https?://[^\s<>"'')\]}}]+')), '.,;:!?)]}}''"'), 'URL', 0.9 FROM t
    UNION ALL SELECT doc_id, lower(unnest(regexp_extract_all(t, '\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}\b'))), 'EmailAddress', 0.9 FROM t
    UNION ALL SELECT doc_id, lower(raw), 'Hash', round(CASE WHEN length(raw) = 64 THEN 0.7 ELSE 0.6 END + CASE WHEN NOT regexp_matches(substr(t, greatest(1, instr(t, raw) - 200), length(raw) + 200 + least(200, instr(t, raw) - 1)),
      '(?i)\b(?:hash|md5|sha1|sha256|sha-1|sha-256|checksum|ioc|indicator|malware|sample|binary|payload|artifact)\b') THEN 0 WHEN length(raw) = 64 THEN 0.25 ELSE 0.3 END, 2)
    FROM (SELECT doc_id, t, unnest(list_distinct(regexp_extract_all(t, '\b(?:[a-fA-F0-9]{{64}}|[a-fA-F0-9]{{40}}|[a-fA-F0-9]{{32}})\b'))) AS raw FROM t)
    UNION ALL SELECT doc_id, a, 'IPAddress', 0.95 FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b')) AS a FROM t) WHERE list_max(list_transform(string_split(a, '.'), lambda x: x::INTEGER)) <= 255)
    SELECT DISTINCT doc_id, name, entity_type, CAST(confidence AS DOUBLE) AS confidence FROM w""",
)
def f13(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.expr(_SEEN).alias("text"))
    return ind.indicators(docs, "doc_id")


_PLACED = "concat(lang, ' at ', doc_id % 120, '.5N, ', doc_id % 200, '.25°W and 34°0', doc_id % 10, '′12″S 118°15′30″E; again ', doc_id % 120, '.5N, ', doc_id % 200, '.25°W.')"


@query(
    "d8_coordinates",
    rf"""WITH t AS (SELECT doc_id, {_PLACED} AS t FROM documents), r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '{geo.DECIMAL}')) AS raw FROM t),
    c AS (SELECT doc_id, CAST(regexp_extract(raw, '{geo.DECIMAL}', 1) AS DOUBLE) AS lat, -CAST(regexp_extract(raw, '{geo.DECIMAL}', 3) AS DOUBLE) AS lng, 'decimal' AS format FROM r)
    SELECT doc_id, lat, lng, format FROM c WHERE lat <= 90 AND lng >= -180 UNION ALL SELECT doc_id, round(-(34 + (doc_id % 10) / 60 + 12 / 3600), 9), round(118 + 15 / 60 + 30 / 3600, 9), 'dms' FROM t""",
)
def d8(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(geo.coordinates(F.expr(_PLACED))).alias("c"))
    return found.select("doc_id", F.round("c.lat", 9).alias("lat"), F.round("c.lng", 9).alias("lng"), "c.format")


@query(
    "a28_scores",
    """WITH p AS (SELECT DISTINCT doc_id, lang FROM documents WHERE contains(lower(text), 'un')), e AS (SELECT DISTINCT d.doc_id, lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 1),
    j AS (SELECT coalesce(p.lang, e.lang) AS lang, count(*) FILTER (p.doc_id = e.doc_id) AS tp, count(*) FILTER (e.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM p FULL JOIN e ON p.doc_id = e.doc_id AND p.lang = e.lang GROUP BY 1)
    SELECT lang, tp AS true_positives, fp AS false_positives, fn AS false_negatives, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM j""",
)
def a28(spark, d):
    docs = table(spark, d, "documents")
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return ev.scores(docs.filter(F.contains(F.lower("text"), F.lit("un"))), docs.join(good, "doc_id"), ["doc_id"], "lang")
