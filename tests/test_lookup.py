"""Full-text lookup, ranges, versions and dates: cases that the SQL of their queries doesn't show."""

import random

import pytest
from pyspark.sql import functions as F

from sleuthgrid.functions import dates
from sleuthgrid.operators import fulltext, ranges
from sleuthgrid.sources import versions
from tests.plan_rows import most_rows


def test_index_skips_blocks_and_is_kept(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(fulltext, "BLOCK", 5)
    monkeypatch.setattr(fulltext, "FIRST", 1)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words[: 3 + i % 28]) for _ in range(rng.randrange(0, 9)))) for i in range(200)] + [(500, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    queries = spark.createDataFrame([(k, " ".join(rng.sample(words, 3))) for k in range(10)] + [(98, "zzz"), (99, None)], "query long, text string")
    index = fulltext.build(docs)
    index.save(str(tmp_path))
    again = fulltext.Index.open(spark, str(tmp_path))
    got = {tuple(r) for r in fulltext.search(again, queries, 7).select("query", "id", "rank").collect()}
    monkeypatch.setattr(fulltext, "FIRST", 10_000)  # scores every block
    assert got == {tuple(r) for r in fulltext.search(index, queries, 7).select("query", "id", "rank").collect()}
    assert {r["query"] for r in fulltext.lookup(index, docs, queries).collect()} == set(range(10))


def test_contains_short_queries(spark):
    docs = spark.createDataFrame([(1, "Alpha"), (2, "beta"), (3, None), (4, "a%b")], "id long, text string")
    queries = spark.createDataFrame([(1, "A"), (2, "ph"), (3, "%b"), (4, ""), (5, None), (6, "BETA")], "query long, text string")
    got = {(r["query"], r["id"]) for r in fulltext.containing(docs, queries, 5).collect()}
    assert got == {(1, 1), (1, 2), (1, 4), (2, 1), (3, 4), (6, 2)}


def test_ranges_overlap_and_nulls(spark, monkeypatch):
    rng = random.Random(2)
    spans = [(i, lo, lo + rng.randrange(-5, 400)) for i, lo in enumerate(rng.randrange(0, 1024) for _ in range(60))] + [(90, None, 5), (91, 5, None), (92, 0, 1023), (93, 0, 1023)]
    numbers = [*range(0, 1024), None, 2000, -1] + [7] * 50
    monkeypatch.setattr(ranges, "split_join", lambda *a: __import__("sleuthgrid.operators.steps", fromlist=["x"]).split_join(*a, most=10, least=5))
    got = ranges.locate(spark.createDataFrame([(x,) for x in numbers], "x long"), "x", spark.createDataFrame(spans, "range_id long, lo long, hi long"), 10).collect()
    assert len(got) == len(numbers)
    for r in got:
        held = [(hi - lo, i) for i, lo, hi in spans if None not in (lo, hi) and r["x"] is not None and lo <= r["x"] <= hi]
        assert r["range_id"] == (min(held)[1] if held else None)


def test_versions_are_whole(spark, tmp_path):
    table = versions.VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(LookupError):
        table.read()
    assert table.commit(spark.range(3).toDF("id"), "first", at=100) == 1
    assert table.commit(spark.range(5).toDF("id"), "second", at=200) == 2
    spark.range(99).toDF("id").write.parquet(f"{tmp_path}/t/data-of-a-killed-writer")
    assert table.read().count() == 5 and table.read(number=1).count() == 3 and table.read(as_of=150).count() == 3
    with pytest.raises(LookupError):
        table.read(as_of=50)
    assert [v["label"] for v in table.versions()] == ["first", "second"]
    stale = table.versions()
    table.versions = lambda: stale[:1]  # a writer that hasn't seen the second
    with pytest.raises(RuntimeError):
        table.commit(spark.range(1).toDF("id"))
    del table.versions
    assert table.read().count() == 5
    table.forget(1)
    assert [v["number"] for v in table.versions()] == [2]


def test_cache_expiry_and_latest(spark, tmp_path):
    cache = versions.VersionedTable(spark, f"file://{tmp_path}/c")
    schema = "provider string, observable string, fetched_at long, expires_at long, payload string"
    versions.upsert(cache, spark.createDataFrame([("p", "a", 1, 10, "old"), ("p", "b", 1, None, "kept"), ("p", "c", 1, 5, "gone")], schema))
    versions.upsert(cache, spark.createDataFrame([("p", "a", 2, 20, "new"), ("p", "b", 0, None, "older")], schema))
    asked = spark.createDataFrame([("p", x) for x in "aabcd"] + [("q", "a")], "provider string, observable string")
    fresh, missed = versions.look_up(asked, cache.read(), F.lit(5))
    assert {(r["observable"], r["payload"]) for r in fresh.collect()} == {("a", "new"), ("b", "kept")}
    assert {tuple(r) for r in missed.collect()} == {("p", "c"), ("p", "d"), ("q", "a")}


CASES = {
    "12 March 2026": ("2026-03-12", "2026-03-12", "day"),
    "March 2026": ("2026-03-01", "2026-03-31", "month"),
    "december 2026": ("2026-12-01", "2026-12-31", "month"),
    "2024": ("2024-01-01", "2024-12-31", "year"),
    "Q1 2026": ("2026-01-01", "2026-03-31", "month"),
    "in q4, of 2025 perhaps": ("2025-10-01", "2025-12-31", "month"),
    "between March and June 2026": ("2026-03-01", "2026-06-30", "month"),
    "between 2019 and 2021": ("2019-01-01", "2021-12-31", "year"),
    "between whenever and June 2026": ("2026-06-01", "2026-06-30", "month"),
    "since 2024": ("2024-01-01", "2024-12-31", "year"),
    "from the 2nd of May, 2021": None,
    "early March 2026": ("2026-03-01", "2026-03-11", "month"),
    "late 2024": ("2024-08-31", "2024-12-31", "year"),
    "Mon, 3rd of Feb. 2020": ("2020-02-03", "2020-02-03", "day"),
    "29 February 2024": ("2024-02-29", "2024-02-29", "day"),
    "29 February 2023": None,
    "03/04/2021": ("2021-03-04", "2021-03-04", "day"),
    "25/04/2021": ("2021-04-25", "2021-04-25", "day"),
    "2026-03-12T10:20:00Z": ("2026-03-12", "2026-03-12", "day"),
    "last Tuesday": None,
    "12 March": None,
    "early spring": None,
    "": None,
    None: None,
}


def test_date_phrases(spark):
    df = spark.createDataFrame([(t, 1) for t in CASES], "text string, precision_of int")
    for r in dates.resolve(df, "text").collect():
        want = CASES[r["text"]]
        got = (str(r["t_start"])[:10], str(r["t_end"])[:10], r["precision"]) if r["t_start"] else None
        assert got == want, r
        assert (r["date_text"] == r["text"].strip()) if want else r["date_text"] is None


def test_absorbing_turns_and_makes(spark):
    entities = spark.createDataFrame([("strike", "Event", 1), ("12 March 2026", "Date", 2), ("soon", "Date", 3), ("2024", "Date", 4), ("Bob", "Person", 5)], "name string, entity_type string, position int")
    edges = spark.createDataFrame([(1, "soon", "strike", "OCCURRED_ON"), (2, "12 March 2026", "strike", "OCCURRED_ON"), (3, "strike", "2024", "OCCURRED_ON"), (4, " raid ", "2024", "OCCURRED_ON"), (5, "Bob", "2024", "OCCURRED_ON"), (6, "Bob", "strike", "USES")], "position int, source_name string, target_name string, rel_type string")
    found, turned, gone = dates.absorb(entities, edges)
    assert {(r["name"], r["date_text"], r["made"]) for r in found.collect()} == {("strike", "12 March 2026", False), ("raid", "2024", True)}
    assert {(r["position"], r["source_name"], r["target_name"]) for r in turned.collect()} == {(1, "strike", "soon"), (2, "strike", "12 March 2026"), (3, "strike", "2024"), (4, " raid ", "2024"), (5, "Bob", "2024"), (6, "Bob", "strike")}
    assert {r["name"] for r in gone.collect()} == {"12 March 2026", "2024"}


def test_wide_ranges_make_no_pairs(spark):
    """Numbers that lie in hundreds of ranges each: the narrowest, without a row for each range."""
    n = 600
    wide = [(i, i, 2**31 + i * (7 if i % 3 else 1)) for i in range(n)]
    rows = [(i, i * 1_000_003 % 2**31) for i in range(n)]
    found = []
    located = lambda: ranges.locate(spark.createDataFrame(rows, "k int, x long"), "x", spark.createDataFrame(wide, "range_id int, lo long, hi long"))
    assert most_rows(spark, lambda: found.extend(located().collect())) < 60 * n
    want = {k: min((hi - lo, i) for i, lo, hi in wide if lo <= x <= hi)[1] for k, x in rows}
    assert {r["k"]: r["range_id"] for r in found} == want


def test_equal_texts_are_scored_once(spark):
    """Texts and queries with the same words make no pairs, and the best documents are those of scoring all."""
    import math
    from collections import Counter

    rng = random.Random(4)
    kinds = ["red ring", "Ring red", "red bolt", "red red ring", "blue bolt nut", "Supplier#1 nut"]
    rows = [(i, kinds[i % 6] if i else None) for i in range(900)]
    asked = [(k, rng.choice(["red ring", "ring, RED", "bolt bolt blue", "zzz nut", "pplier#", "PPLIER#"])) for k in range(700)]
    docs, queries = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(asked, "query long, text string")
    found = []
    assert most_rows(spark, lambda: found.extend(fulltext.lookup(fulltext.build(docs), docs, queries, 20).collect())) <= 700 * 20
    cut_ = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    tf = {i: Counter(cut_(t)) for i, t in rows}
    df = Counter(w for x in tf.values() for w in x)
    mean = sum(sum(x.values()) for x in tf.values()) / len(tf)
    want = set()
    for k, q in asked:
        score = {}
        for w, times in Counter(cut_(q)).items():
            for i, x in tf.items():
                if w in x:
                    score[i] = score.get(i, 0) + times * math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)) * x[w] * 2.2 / (x[w] + 1.2 * (0.25 + 0.75 * sum(x.values()) / mean))
        best = sorted(score, key=lambda i: (-round(score[i], 6), i)) or [i for i, t in rows if t and q.lower() in t.lower()]
        want |= {(k, i, r) for r, i in enumerate(best[:20], 1)}
    assert {tuple(r) for r in found} == want
