"""Packing: pieces against the library, sequences without gaps, patterns against bounds."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sleuthgrid.llm import packing
from sleuthgrid.llm.packing import SIZE, Places, byte_encoder, pack, patterns

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


ODD = ["", " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "a\n b", "\n", "\na", "a\n", "a\tb", "a\r\nb", "don't  stop", "it's 12 o'clock", "x y z", "é́ ß 漢字 🎉 b", "<|endoftext|> a b", "a\x1cb c", "a b 　c d", " 　 ", "a b\u0085 c", "a <| b"]


def test_ids_are_the_librarys(library):
    encode = byte_encoder(PATH, most=50, block=40)
    long = ["word " * 300, "x" * 5000, " " * 3000, "a b\n" * 100, "ab  cd " * 50, "a\n" * 200]
    for text in ODD + long + [t * 7 for t in ODD]:
        got = np.frombuffer(b"".join(encode(text)), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, repr(text[:60])


def check(docs, rows, library, size=SIZE):
    """Each id lies in one piece, digests are those of the library's ids, and sequences have no gaps."""
    ids = defaultdict(list)
    for doc_id, text in docs:
        ids[doc_id].append(library.encode(text or "", add_special_tokens=False).ids + [0])
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for doc_id, found in by_doc.items():
        if len(ids[doc_id]) > 1:
            assert sum(r["length"] for r in found) == sum(map(len, ids[doc_id]))
            continue
        at, (want,) = 0, ids[doc_id]
        for r in sorted(found, key=lambda r: r["start"]):
            part = want[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["length"] == len(part)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    padded = tokens = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= size
        tokens, padded = tokens + at, padded + (0 if at & (at - 1) == 0 else size - at)
    return padded / max(1, tokens)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pack(docs, PATH).collect()
    assert check([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], rows, library) < 0.001
    assert len({r["sequence_id"] for r in rows}) == max(r["sequence_id"] for r in rows) + 1


def test_hard_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, "long text\n" * 20_000), (None, "no id"), (None, None), (7_000, "twice"), (7_000, "twice"), (7_000, "other")]
    rows += [(1000 + i, "copy of one text") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("length", F.lit("clash")).withColumn("rank", F.lit(1)).withColumn("digest", F.lit("x")).repartition(5)
    got = pack(df, PATH).collect()
    assert check(rows, got, library) < 0.01
    assert sorted(len(x) for x in [[r for r in got if r["doc_id"] is None]]) and sum(r["length"] for r in got if r["doc_id"] is None) == len(library.encode("no id").ids) + 2
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def brute(histogram, size):
    """Least cost by trying all multisets, for few pieces."""
    from functools import cache

    cost = lambda w: w if w & (w - 1) == 0 else size

    @cache
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        out = [10**9]

        def grow(i, used, total):
            out[0] = min(out[0], cost(total) + best(tuple(x for j, x in enumerate(rest) if j not in used)))
            for j in range(i, len(rest)):
                if total + rest[j] <= size:
                    grow(j + 1, used | {j}, total + rest[j])

        grow(0, frozenset(), first)
        return out[0]

    return best(tuple(sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True)))


def test_linear_program_is_a_bound_and_covers():
    rng = np.random.default_rng(3)
    for _ in range(40):
        size = 16
        histogram = {}
        for x in rng.integers(1, size + 1, rng.integers(1, 9)):
            histogram[int(x)] = histogram.get(int(x), 0) + 1
        solved = patterns(histogram, size, gap=1e-9)
        made = defaultdict(float)
        value = 0.0
        for pattern, times in solved:
            total = sum(x * n for x, n in pattern.items())
            assert total <= size
            value += times * float(packing._cost(np.array(total), size))
            for x, n in pattern.items():
                made[x] += n * times
        assert all(abs(made[x] - n) < 1e-6 for x, n in histogram.items())
        assert sum(x * n for x, n in histogram.items()) - 1e-6 <= value <= brute(histogram, size) + 1e-6


def test_places_are_exact():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 300, 20_000):
        histogram = {}
        for x in np.clip(rng.lognormal(5, 1.3, n).astype(int), 1, SIZE):
            histogram[int(x)] = histogram.get(int(x), 0) + 1
        places = Places(histogram)
        filled = defaultdict(list)
        for x, k in histogram.items():
            seq, off, cut = places.find(np.full(k, x), np.arange(k))
            for s, o, c in zip(seq, off, cut, strict=True):
                for a, b, m in [(s, o, x)] if c < 0 else places.cuts[int(c)]:
                    filled[int(a)].append((int(b), int(m)))
        for parts in filled.values():
            at = 0
            for o, m in sorted(parts):
                assert o == at
                at += m
            assert at <= SIZE
        assert sum(m for p in filled.values() for _, m in p) == sum(x * k for x, k in histogram.items())
        assert len(filled) == places.n_sequences
