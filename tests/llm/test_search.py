import random

import numpy as np

from sleuthgrid.llm.decontaminate import RATE, Items, align, passages, points
from sleuthgrid.llm.warc_revisit import canonical_url, resolve


def semi_global(item, text):
    row = [(0, j) for j in range(len(text) + 1)]
    for i, c in enumerate(item, 1):
        new = [(i, 0)]
        for j, d in enumerate(text, 1):
            new.append(min((row[j - 1][0] + (c != d), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    return min(x[0] for x in row)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        what = rng.randrange(3)
        if what == 0:
            t[i] = "#"
        elif what == 1:
            del t[i]
        else:
            t.insert(i, "%")
    return "".join(t)


def test_align_finds_fewest_edits():
    rng = random.Random(1)
    for _ in range(200):
        item = "".join(rng.choice("abcd ") for _ in range(rng.randrange(5, 40)))
        text = "xyz" * 3 + edited(rng, item, rng.randrange(4)) + "zyx" * 3
        best = semi_global(item, text)
        got = align(points(item), points(text), -40, 60, len(item))
        assert got[0] == best
        assert semi_global(item, text[got[1] : got[2]]) == best


def test_passages_against_brute_force(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randrange(12, 40))) for i in range(12)] + [(12, "tiny"), (13, ""), (14, None)]
    docs = []
    for i in range(80):
        body = say(rng.randrange(20, 60))
        if i % 2:
            item = items[rng.randrange(12)][1]
            body += " " + edited(rng, item.upper() if i % 5 == 0 else item, rng.randrange(int(1.6 * RATE * len(item)) + 1)) + " " + say(20)
        docs.append((i, body))
    docs += [(80, None), (81, ""), (82, "has tiny in it"), (82, "has tiny in it")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = passages(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    want = set()
    for d, t in docs:
        for i, x in items[:12]:
            if t and semi_global(x.lower(), t.lower()) <= int(RATE * len(x)):
                want.add((d, i))
    assert found == want | {(82, 12)} and sum(r.doc_id == 82 for r in got) == 2
    assert all(semi_global(dict(items)[r.item_id], dict(docs)[r.doc_id].lower()[r.start : r.stop]) == r.edits for r in got)
    assert passages(df, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert np.all(points("İa") == [0x130, 97]) and list(Items([]).find("abc")) == []


def test_repeated_grams_equal_items_and_names(spark):
    import time

    start = time.process_time()
    equal = Items([(i, "ab " * 100) for i in range(200)])
    found = list(equal.find("ab " * 2000))
    assert len(found) >= 200 * 15 and {f[3] for f in found} == {0} and {f[0] for f in found} == set(range(200))
    alike = Items([(i, "ab " * 90 + str(i)) for i in range(20)])
    assert {f[0] for f in alike.find("ab " * 2000)} == set(range(20))
    assert time.process_time() - start < 30
    item = "The quick brown fox jumps over the lazy dog near the river bank."
    long = "some other words here " * 40_000 + item + " and so on" * 20_000
    docs = spark.createDataFrame([(7, 1, long), (8, 2, None)], "item_id long, START int, text string")
    rows = passages(docs, spark.createDataFrame([(3, item), (4, item)], "item_id long, text string"), keys=("item_id", "START")).collect()
    assert [(r["item_id"], r["START"], r["item_id_"], r["edits"]) for r in sorted(rows)] == [(7, 1, 3, 0), (7, 1, 4, 0)]
    assert rows[0]["start_"] == 880_000 and rows[0]["stop"] == 880_000 + len(item)


def test_header_names_that_differ_by_case(spark):
    from sleuthgrid.llm.warc_revisit import resolve

    rows = [(1, "http://a.b/x", 1, "response", 200, {"ETag": "1", "etag": "2"}), (2, "http://a.b/x", 5, "revisit", 304, {"ETAG": "1", "eTag": "9"}), (3, None, 6, "revisit", 304, None)]
    df = spark.createDataFrame(rows, "capture_id long, url string, ts long, kind string, status int, headers map<string,string>")
    got = {r.capture_id: r for r in resolve(df.withColumn("slice", df.ts).withColumn("found", df.ts)).collect()}
    assert got[2].outcome == "resolved" and got[2].headers == {"etag": "1"} and got[3].outcome == "no_response"


def test_sql_of_all_queries(spark):
    """Each query with SQL gives the rows that DuckDB gives."""
    import glob

    import duckdb

    from sleuthgrid.llm import queries

    duck = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        duck.execute(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM '{p}'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, "/root/testdata/sf0.001")
        want = duck.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, want.fetchall())), name


def test_revisits_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit"])
        tag = rng.choice(['"a"', 'W/"a"', '"b"', None])
        head = {"ETag": tag, "Last-Modified": rng.choice(["m1", "m2"]), "X-Own": str(i), "Date": str(i)}
        url = rng.choice(["http://www.a.org/p", "https://A.org/p/?utm_x=1", "http://a.org/q?b=2&a=1", "a.org/q?a=1&b=2#z", None])
        rows.append((i, url if i % 90 else None, rng.randrange(60) if i % 70 else None, kind, rng.choice([200, 200, 404]) if kind == "response" else 304, {k: v for k, v in head.items() if v}))
    df = spark.createDataFrame(rows, "capture_id long, url string, ts long, kind string, status int, headers map<string,string>")
    keys = {r.capture_id: r.k for r in df.select("capture_id", canonical_url(df.url).alias("k")).collect()}
    assert {k for k in keys.values() if k} == {"a.org/p", "a.org/q?a=1&b=2"}
    got = {r.capture_id: r for r in resolve(df).collect()}
    assert set(got) == {r[0] for r in rows if r[3] == "revisit"}
    bare = lambda t: t and t.replace("W/", "")
    for r in rows:
        if r[3] != "revisit":
            continue
        best = max(((x[2], x[0], x) for x in rows if x[3] == "response" and x[4] == 200 and x[2] is not None and r[2] is not None and x[2] < r[2] and keys[x[0]] and keys[x[0]] == keys[r[0]]), default=None)
        g = got[r[0]]
        if best is None:
            assert (g.outcome, g.response_id) == ("no_response", None)
            continue
        old, new = best[2][5], r[5]
        if "ETag" in old and "ETag" in new:
            same = bare(old["ETag"]) == bare(new["ETag"])
        else:
            same = old["Last-Modified"] == new["Last-Modified"]
        assert (g.outcome, g.response_id) == ("resolved" if same else "changed", best[1])
        if same:
            want = {k.lower(): v for k, v in old.items()} | {k.lower(): v for k, v in new.items() if k != "X-Own"}
            assert g.headers == want
    assert resolve(df.limit(0)).count() == 0
