import hashlib
import random
import re

import xxhash

from sleuthgrid.llm.simhash import edited_fingerprints, hamming_search


def brute(text):
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text) if w]
    votes, n = [0] * 64, len(words)
    for i, w in enumerate(words):
        h = xxhash.xxh64_intdigest((words[i - 1] if i else "").encode(), xxhash.xxh64_intdigest(w.encode(), 42))
        for k in range(64):
            votes[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * votes[k] > n)


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i * 7 % 101, " ".join(rng.choice(["é🙂", "ab", "cde", "f", "gh\n"]) + str(rng.randrange(9)) for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    rows += [(200, ""), (201, None), (202, "one"), (203, rows[3][1])]
    got = {r.doc_id: r for r in edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    order = sorted((i, t or "") for i, t in rows)
    fps = {i: brute(t) for i, t in order}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[1][:cut]
        g = got[i]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.fingerprint == f"{fps[i]:016x}" and g.edited_fingerprint == f"{brute(edited):016x}"
        assert g.near_edited == 1 - (fps[i] ^ brute(edited)).bit_count() / 64
        assert g.near_next == 1 - (fps[i] ^ fps[after[0]]).bit_count() / 64
        assert g.n_within == (sum((fps[i] ^ f).bit_count() <= 3 for f in fps.values()) if i % 20 == 0 else None)


def test_search_and_edges(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    base += [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base[:30] for n in (1, 2, 3, 4)]
    signed = [b - (1 << 64) if b >> 63 else b for b in base]
    df = spark.createDataFrame([(x,) for x in [*signed, signed[0]]], "fp long")
    got = {r.fp: r.n_within for r in hamming_search(df.limit(50), df).collect()}
    for x in {r.fp for r in df.limit(50).collect()}:
        assert got[x] == sum(((x ^ y) & (1 << 64) - 1).bit_count() <= 3 for y in [*signed, signed[0]])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert edited_fingerprints(empty).count() == 0
    same = spark.createDataFrame([(None, "a b", 1), (1, "a b", 2), (1, "a b", 3)], "doc_id long, text string, n_chars int")
    assert {r.near_next for r in edited_fingerprints(same).collect()} == {1.0}
