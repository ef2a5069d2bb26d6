"""Text functions on cases by hand."""

from pyspark.sql import functions as F

from sleuthgrid.functions import chunks, indicators, quality, text


def one(spark, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r.x for r in df.withColumn("x", expression).orderBy("i").collect()]


def test_markup_and_names(spark):
    marked = ["## A **bold** [NATO](http://n) said[[27]](http://w#c).\n\n\n\n> quote _Yi Peng 3_ snake_case_x", "[[edit](http://e)] Text [cut](http://x", '://en.w.org/B "Baltic Sea"). The end', None]
    assert one(spark, marked, text.strip_markup(F.col("v"))) == ["A bold NATO said.\n\nquote Yi Peng 3 snake_case_x", "Text cut", "The end", None]
    names = ["## disruptions", "**Yi Peng 3**", "Europe]", "BBC (Spanish)](https://b.c/m", "[Collection] Germany", "[Half", '- "Quoted" ']
    assert one(spark, names, text.clean_name(F.col("v"))) == ["disruptions", "Yi Peng 3", "Europe", "BBC (Spanish)", "[Collection] Germany", "Half", "Quoted"]


def test_indicators(spark):
    body = "See evil[.]com and hxxps://bad.org/x. Mail A(at)b[.]net; share?url=https%3A%2F%2Fcybel.com%2F 2fa.example.com; ip 1.2.3.4 999.1.1.1 and 1.2.3.4. "
    body += "The malware sample " + "ab" * 32 + " " * 300 + "cd" * 16 + " CVE-2024-12345 T1059.001 Type 052D on May 7, 2021 and Q3 2021."
    got = {(r.name, r.entity_type): r.confidence for r in indicators.indicators(spark.createDataFrame([(1, body), (2, None)], "k int, text string"), "k").collect()}
    want = {
        ("evil.com", "Domain"): 0.9, ("bad.org", "Domain"): 0.9, ("b.net", "Domain"): 0.9, ("cybel.com", "Domain"): 0.9, ("2fa.example.com", "Domain"): 0.9, ("https://bad.org/x", "URL"): 0.9,
        ("a@b.net", "EmailAddress"): 0.9, ("1.2.3.4", "IPAddress"): 0.95, ("ab" * 32, "Hash"): 0.95, ("cd" * 16, "Hash"): 0.6, ("CVE-2024-12345", "Vulnerability"): 0.95,
        ("T1059.001", "TTP"): 0.9, ("Type 052D", "EquipmentType"): 0.85, ("May 7, 2021", "Date"): 0.95, ("Q3 2021", "Date"): 0.95,
    }
    assert got == want
    uuid = "0123abcd-0123-4567-89ab-0123456789ab"
    more = f"id {uuid} and {uuid.replace('-', '')} at a.co, b.co.jp, c.example.in, d.nosuchending, e.lan"
    found = {(r.name, r.entity_type) for r in indicators.indicators(spark.createDataFrame([(1, more)], "k int, text string"), "k").collect()}
    assert found == {("a.co", "Domain"), ("b.co.jp", "Domain"), ("c.example.in", "Domain")}
    lan = indicators.indicators(spark.createDataFrame([(1, "e.lan a.co")], "k int, text string"), "k", endings=("lan",)).collect()
    assert [r.name for r in lan] == ["e.lan"]


def test_passages(spark):
    rows = ["Alpha beta gamma are here today. Only alpha is in this sentence. Nothing at all in this one! Beta and alpha in the last one.", "short. tiny.", None]
    got = one(spark, rows, text.passages(F.col("v"), ["Alpha", "beta"], most=2))
    assert [(x.text, x.score) for x in got[0]] == [("Alpha beta gamma are here today.", 2), ("Beta and alpha in the last one.", 2)] and got[1] == [] and got[2] is None
    assert len(one(spark, rows, text.passages(F.col("v"), ["alpha"], most_chars=50))[0]) == 1


def test_chunks():
    assert chunks.chunk("") == [] and chunks.chunk(" \n") == [] and chunks.chunk("a b", 10) == ["a b"]
    assert chunks.chunk("aaaa\n\nbbbb\n\ncccc", 10, 2) == ["aaaa\n\nbbbb", "cccc"]
    words = " ".join(f"w{i}" for i in range(20))
    got = chunks.chunk(words, 20, 4)
    assert all(len(c) <= 20 + 5 for c in got) and got[0] == "w0 w1 w2 w3 w4 w5 w6" and got[1].startswith("5 w6 w7")
    sentences = "One two three. Four five six. Seven eight nine."
    assert chunks.chunk(sentences, 20, 0) == ["One two three.", "Four five six.", "Seven eight nine."]


def test_pages_and_hosts(spark):
    kind = F.lit("URL")
    assert one(spark, ["https://x.com/a", "citrix.com", "https://m.facebook.com", "http://a.b/c.png?x#y", "cdn-1.a.b", None], quality.web_chrome(F.col("v"), kind)) == [True, False, True, True, True, False]
    assert one(spark, [".gov", "a.org", "2fen.wikipedia.org", "2fa.com", "ab.org", "http://a", None], quality.malformed_host(F.col("v"), kind)) == [True, True, True, False, False, False, True]
    assert one(spark, ["MV Aurora", "MVAurora", "mq-9 Reaper", "Plain"], quality.type_hint(F.col("v"), F.lit("Custom"))) == ["Ship", "Custom", "Drone", "Custom"]
    urls = ["http://Localhost/", "http://10.1.2.3", "http://172.15.0.1/", "http://240.0.0.1/", "http://0x7f.1/", "http://2130706433/", "https://[fe80::1]/", "https://[2001:4860::1]/", "https://redis:1/", "https://a.b/", "ftp://a.b", None]
    assert one(spark, urls, text.safe_url(F.col("v"))) == [False, False, True, False, False, False, False, True, False, True, False, False]
    assert one(spark, ["\t=1", "\n +a", "a=1", " @x", None], text.guard_cell(F.col("v"))) == ["'\t=1", "'\n +a", "a=1", "' @x", None]


def test_resolution(spark):
    from sleuthgrid.operators.resolution import jaro_winkler, resolve

    assert abs(jaro_winkler("dwayne", "duane") - 0.84) < 1e-9 and abs(jaro_winkler("martha", "marhta") - 0.9611) < 1e-3 and jaro_winkler("", "a") == 0
    known = [("Vladimir Putin", "Person", 0), ("MV Northern Star", "Ship", 1), ("evil.com", "Domain", 2), ("Acme Corporation", "Organization", 3), ("Acme Corporatiom", "Organization", 4), ("Star", "", 5)]
    existing = spark.createDataFrame(known, "name string, entity_type string, position int")
    asked = [("Putin", "Person"), ("MV Northern Star strike", "Event"), ("evil.con", "Domain"), ("EVIL.com ", "Domain"), ("acme corporation", "Organization"), ("Acme Corporations", "Organization"), ("Acme Corporations", "Company"), ("Nobody", None)]
    got = {(r.name, r.entity_type): (r.match, r.rule) for r in resolve(spark.createDataFrame(asked, "name string, entity_type string"), existing, parents={"Company": "Org", "Organization": "Org"}).collect()}
    assert got == {
        ("Putin", "Person"): ("Vladimir Putin", "part"), ("MV Northern Star strike", "Event"): (None, None), ("evil.con", "Domain"): (None, None), ("EVIL.com ", "Domain"): ("evil.com", "exact"),
        ("acme corporation", "Organization"): ("Acme Corporation", "exact"), ("Acme Corporations", "Organization"): ("Acme Corporation", "fuzzy"), ("Acme Corporations", "Company"): ("Acme Corporation", "fuzzy"), ("Nobody", ""): (None, None),
    }


def test_sentences_trim_white_space_alone(spark, tmp_path):
    """Digits at the ends stay, tabs and line ends go, and the SQL says the same."""
    import duckdb

    from sleuthgrid.plans import catalog, text_queries  # noqa: F401  registers the queries

    rows = ["0 begins and ends with 0", "This is number one here.  1 is at its place 1\t\n", "\n A line before it all, and\x0bone more of them.\x0b After it all", "Twenty characters ar", "a\x01Twenty characters are one part", None, ""]
    assert one(spark, rows[:2], text.sentences(F.col("v"))) == [["0 begins and ends with 0"], ["This is number one here."]]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(catalog.ORACLES["f8_sentences"]).fetchall()
    assert sorted(tuple(r) for r in catalog.QUERIES["f8_sentences"](spark, str(tmp_path)).collect()) == sorted(want)
