import hashlib
import random
import re

from sleuthgrid.llm.substring_dedup import remove_repeats


def brute(rows, window):
    seen, out = {}, []
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i, w in sorted(words.items()):
        for p in range(len(w) - window + 1):
            seen.setdefault(tuple(w[p : p + window]), (i, p))
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] < (i, p):
                gone |= set(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}é" for i in range(60)]
    passage = [rng.choice(vocab) for _ in range(50)]
    rows = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 90))]
        if i % 3 == 0:
            w[10:10] = passage[i % 7 : 20 + i % 30]
        rows.append((i, "\t \n".join(w)))
    rows += [(60, rows[5][1]), (61, rows[5][1] + " tail"), (62, None), (63, ""), (64, "a b " * 60), (65, " ".join(passage * 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute(rows, 20)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty).count() == 0
    text = " ".join(f"x{i}" for i in range(25))
    df = spark.createDataFrame([(None, text, 1), (3, text, 2), (3, text, 3)], "doc_id long, text string, n_words int")
    got = {tuple(r) for r in remove_repeats(df).select("doc_id", "n_removed").collect()}
    assert got == {(None, 0), (3, 25)}


def test_equal_hashes_are_not_equal_words(spark):
    def thue_morse(a, b, n=10):
        x, y = a, b
        for _ in range(n):
            x, y = x + y, y + x
        return x

    from sleuthgrid.llm.hashing import word_hashes

    one, two = thue_morse("a", "b"), thue_morse("b", "a")
    h = word_hashes(f"{one} {two} {one}".encode())
    assert h[0] == h[2] != h[1]
    start = [f"w{i}" for i in range(19)]
    df = spark.createDataFrame([(1, " ".join([*start, one])), (2, " ".join([*start, two])), (3, "\n".join([*start, one]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 20}


def test_names_and_long_texts(spark):
    long = " ".join(f"x{i % 5000}" for i in range(120_000))
    df = spark.createDataFrame([(1, long, 7, 8, 9), (2, long, 7, 8, 9)], "doc_id long, text string, ID int, tkey int, row int")
    got = sorted(map(tuple, remove_repeats(df).select("doc_id", "ID", "tkey", "row", "n_words", "n_removed").collect()))
    assert got == [(1, 7, 8, 9, 120_000, 115_000), (2, 7, 8, 9, 120_000, 120_000)]


def test_hot_passage_by_broadcast(spark):
    from sleuthgrid.llm import common

    left = spark.createDataFrame([(1, i) for i in range(100)] + [(k, 0) for k in range(2, 20)], "k long, v long")
    right = left.groupBy("k").count()
    plain = left.join(right, "k")
    got = common.spread_join(left, right, ["k"], "count", most=5, least=10)
    assert sorted(map(tuple, got.select("k", "v", "count").collect())) == sorted(map(tuple, plain.select("k", "v", "count").collect()))


def test_last_batch_writes_no_run(spark, monkeypatch):
    """What the last batch adds is read by none; runs are compacted when another batch comes to more than fanout."""
    from sleuthgrid.llm import substring_dedup as module

    made, compacted = [], []
    append, compact = module.FingerprintIndex._append, module.FingerprintIndex.compact
    monkeypatch.setattr(module.FingerprintIndex, "_append", lambda self, run: made.append(1) or append(self, run))
    monkeypatch.setattr(module.FingerprintIndex, "compact", lambda self: compacted.append(1) or compact(self))
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(40)]
    passage = [rng.choice(vocab) for _ in range(45)]
    rows = []
    for i in range(40):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        w[5:5] = passage[i % 5 : 24 + i % 20] if i % 2 else []
        rows.append((i, rng.choice([" ", "\n ", "  "]).join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for batches, runs, merges in ((3, 2, 0), (4, 3, 1)):
        made.clear(), compacted.clear()
        got = remove_repeats(df, batches=batches).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got)) == brute(rows, 20)
        assert (len(made), len(compacted)) == (runs, merges)


def test_words_and_hashes_of_any_white_space():
    from sleuthgrid.llm.hashing import word_bounds, word_hashes
    from sleuthgrid.llm.substring_dedup import plain_words

    rng = random.Random(12)
    for n in [*range(60), 300, 2000]:
        text = bytes(rng.choice(b"  \t\n\x0b\x0c\r\x1c\x85\xa0abc\x00") for _ in range(n)) + rng.choice([b"", b"x" * 90])
        words = re.findall(rb"[^\x20\x09-\x0D]+", text)
        assert [text[a:b] for a, b in zip(*word_bounds(text))] == words
        data, starts, ends = plain_words(text)
        assert data == b" ".join(words) and [data[a:b] for a, b in zip(starts, ends)] == words
        assert word_hashes(data, bounds=(starts, ends)).tolist() == word_hashes(text).tolist() == [int(word_hashes(w)[0]) for w in words]
