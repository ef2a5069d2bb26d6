"""The audit of sources against brute force on whole numbers."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sleuthgrid.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def small(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least=10, top=10):
    docs = [(lang or "", source or "", TERM.findall(small(text))) for _, text, lang, source in rows]
    df, counts, every = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in docs:
        df[lang].update(set(found))
        counts[lang, source].update(found)
        every[lang].update(found)
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in df.items()}
    out = []
    for lang in {d[0] for d in docs}:
        terms = kept.get(lang, [])
        v = len(terms)

        def share(c):
            n = sum(c[t] for t in terms)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * v) for t in terms}

        mine = {s: share(counts[x, s]) for x, s in {(d[0], d[1]) for d in docs} if x == lang}
        whole = share(every[lang])
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, p in mine.items():
            found = [("pair", o, sum(f(p[t], q[t]) for t in terms)) for o, q in mine.items() if o != s]
            for rank, (part, item, value) in enumerate(sorted(found, key=lambda x: (-x[2], x[1].encode())), 1):
                out.append((lang, s, part, item, value, rank))
            found = [(t, f(p[t], whole[t])) for t in terms if counts[lang, s][t] and p[t] > whole[t]]
            for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top], 1):
                out.append((lang, s, "term", item, value, rank))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("clash")).withColumn("vid", F.lit(1)).repartition(3)
    return sorted(tuple(r) for r in divergence.query(df).collect())


def corpus(seed, sources, n=150):
    rng = random.Random(seed)
    words = ["the", "The", "of", "élan", "Ünder", "und", "naïve", "漢字", "x1y", "a-b", "end.", "z\x00q"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(n):
        s = rng.choice(sources)
        text = " ".join(rng.choice(words[: 20 + hash(s) % 40 if s else 30]) for _ in range(rng.randrange(0, 40)))
        rows.append((i, rng.choice([text, text, text, None, ""]), rng.choice(["en", "de", None]), s))
    return rows + rows[:10]


def test_against_brute_force(spark):
    sources = ["s1", "s2", "S2", "ß", "", None, "src10"]
    rows = corpus(1, sources)
    rows += [(900 + i, "one " * 3000, "en", "s1") for i in range(12)] + [(950, None, "en", "no terms"), (951, "rare", "xx", "a"), (952, "rare", "xx", "b"), (953, "word " * 400_000, "en", "s2")]
    assert run(spark, rows) == brute(rows)


def test_one_source_one_language_and_none(spark):
    rows = [(i, f"same words {'abcdefgh'[i % 8]}", "en", "s") for i in range(40)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "VECTORS", 5)
    monkeypatch.setattr(divergence, "HELD", 10)
    rows = corpus(2, [f"s{i:02d}" for i in range(11)], 400)
    assert run(spark, rows) == brute(rows)


def test_whole_numbers_do_not_overflow(spark):
    import numpy as np

    for count, over in ((7 * 10**13, 9 * 10**13), (0, 9 * 10**13), (1, 3), (10**9, 10**9 + 2)):
        got = int(divergence._shares(np.array([count], np.uint64), np.array([over], np.uint64))[0])
        assert got == 1 + 10**9 * (count + 2) // over
        row = spark.range(1).select(F.lit(count).cast("long").alias("n"), F.lit(over).cast("long").alias("t"), F.lit(0).cast("long").alias("v")).select(divergence._share("n", "t", "v")).head()
        assert row[0] == got


def test_words_are_cut_between_terms():
    text = "Alpha beta1gamma déjà-VU" * 50
    assert [w.decode() for part in divergence.words(text.encode(), 16) for w in part] == TERM.findall(small(text))
