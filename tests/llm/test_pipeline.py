"""The pipeline, stage by stage, against brute force on a small corpus."""

import hashlib
import random
import re

import pytest

import corpus_pipeline
from sleuthgrid.llm import toxicity
from sleuthgrid.llm.minhash import likeness, shingles
from tests.llm.test_search import semi_global

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
tokens = pytest.importorskip("public_tokenizers")


def corpus(seed=21):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghklmnorstu") for _ in range(rng.randrange(3, 9))) for _ in range(1500)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passage, items = say(60), [" ".join(say(25)) for _ in range(4)]
    rows = []
    for i in range(160):
        w = say(rng.randrange(40, 120))
        if i % 8 == 0:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(("nastyword", "vilething", "foulish")))
        if i % 9 == 4:
            w[20:20] = passage
        if i % 20 == 7:
            w += items[i % 4].split()
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[10 * i + 1][1]) for i in range(5)]  # exact copies
    rows += [(300 + i, rows[10 * i + 2][1] + " tail") for i in range(5)]  # near ones
    rows += [(None, " ".join(say(50))), (None, " ".join(say(50))), (400, ""), (401, None), (402, "two words"), (10, " ".join(say(45))), (10, " ".join(say(45)))]
    return rows, items


def near_groups(rows):
    """The first row of each group of texts that chains of alike pairs join."""
    classes = {}
    for i, t in rows:
        key = -(2**63) if i is None else i
        classes[t or ""] = min(classes.get(t or "", key), key)
    # of several texts of one id, the first class is that of the smaller hash of its text
    names = sorted(classes, key=lambda t: (classes[t], hashlib.md5(t.encode()).digest()))
    sets, group = {t: shingles(t.encode()) for t in names}, {t: t for t in names}

    def find(t):
        while group[t] != t:
            t = group[t]
        return t

    for a in range(len(names)):
        for b in range(a):
            x, y = names[b], names[a]
            if len(sets[x][0]) and len(sets[y][0]) and likeness(sets[x], sets[y], False) >= 0.8:
                p, q = sorted((find(x), find(y)), key=names.index)
                group[q] = p
    return {(classes[t], t) for t in {find(t) for t in names}}


def without_repeats(rows, window=20):
    first, split = {}, [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = set()
    for (i, t), (_, w) in zip(rows, split, strict=True):
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < (i, p) for q in range(p, p + window)}
        if not gone or len(gone) < len(w):
            out.add((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t or ""))
    return out


def test_stages_against_brute_force(spark, tmp_path):
    import sentencepiece

    rows, items = corpus()
    ids = lambda i: -(2**63) if i is None else i
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(160)], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontaminate", "encode"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    pairs = lambda df: sorted((ids(r.doc_id), r.text or "") for r in df.collect())

    model = toxicity.fit(now, labels)
    caught = [i for i, t in rows if model.probability(model.evidence(toxicity.segments(*(x := model.positives(t or "", {}))[:2]), x[2])) >= 0.3]
    assert len(caught) < len(rows) / 2 and sum(i is not None and i < 160 and i % 8 == 0 for i in caught) >= 15
    kept = stages["toxicity"](spark, now, str(tmp_path)).cache()
    want = sorted((ids(i), t or "") for i, t in rows if i not in caught)
    assert pairs(kept) == want

    single = stages["near_dedup"](spark, kept, str(tmp_path)).cache()
    rows2 = [(r.doc_id, r.text) for r in kept.collect()]
    assert set(pairs(single)) == near_groups(rows2) and single.count() == len(near_groups(rows2)) < len(rows2)

    clean = stages["substring_dedup"](spark, single, str(tmp_path)).cache()
    rows3 = [(ids(r.doc_id), r.text) for r in single.collect()]
    assert set(pairs(clean)) == without_repeats(rows3) != set(pairs(single))
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    apart = stages["decontaminate"](spark, clean, str(tmp_path)).cache()
    want = [(i, t) for i, t in pairs(clean) if not any(semi_global(x.lower(), t.lower()) <= int(0.08 * len(x)) for x in items)]
    assert pairs(apart) == want and len(want) < clean.count()

    lib = sentencepiece.SentencePieceProcessor(model_file=tokens.path("piece_bpe_32k.model"))
    coded = sorted((ids(r.doc_id), r.ids_sha256, r.n_tokens) for r in stages["encode"](spark, apart, str(tmp_path)).collect())
    assert coded == sorted((i, hashlib.sha256(" ".join(map(str, [*lib.encode(t), 2])).encode()).hexdigest(), len(lib.encode(t)) + 1) for i, t in want)

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((ids(r.doc_id), r.ids_sha256, r.n_tokens) for r in whole.collect()) == coded


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
