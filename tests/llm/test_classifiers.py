import math
import random

import numpy as np
import pytest

from sleuthgrid.llm import language, toxicity


def test_segments_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 14)
        s = [rng.choice([-0.5, -0.5, -0.5, 0.7, 1.3, 2.2]) for _ in range(n)]
        places = [i for i, x in enumerate(s) if x > 0]
        got = toxicity.segments(places, [s[i] for i in places])

        def recurse(lo, hi):
            best = max(((round(sum(s[i:j]), 9), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            i = -best[2]
            j = i - best[1]
            return [*recurse(lo, i), (best[0], i, j - 1), *recurse(j, hi)]

        assert [(round(a, 9), i, j) for a, i, j in got] == recurse(0, n)


def test_segments_are_linear():
    import time

    took = []
    for n in (20_000, 160_000):
        start = time.process_time()
        toxicity.segments(list(range(0, 10 * n, 10)), [0.7] * n)
        took.append(time.process_time() - start)
    assert took[1] < 40 * took[0] + 0.5


def _docs(spark):
    rng = random.Random(9)
    words = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = i % 8 == 0
        if toxic:
            for k in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["nastyword", "vilething", "foulish" + "abc"[k % 3]]))
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    rows += [(400, "", "x"), (401, None, "x"), (None, "plain1", "x"), (0, rows[0][1], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = _docs(spark)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 404
    truth = {i: int(i % 8 == 0) for i in range(400)}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    model = toxicity.fit(docs, labels)
    assert 0 <= model.loss < 0.2
    bad = " ".join(["nastyword vilething foulisha"] * 6)
    long = "plain1 plain2 " * 100_000 + bad + " plain3" * 1000
    some = spark.createDataFrame([(1, long), (2, "nastyword vilething"), (3, "plain1 plain2"), (4, None)], "doc_id long, text string")
    spans = {r.doc_id: (r.start, r.stop) for r in toxicity.passages(some, model).collect()}
    assert spans[2] == (0, 19) and long[slice(*spans[1])] == bad and set(spans) == {1, 2}
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert all(r.predicted == 0 for r in none)
    assert toxicity.score(docs.limit(0), toxicity.Model({})).count() == 0


def test_forward_sums_all_segmentations():
    vocab = {x: i for i, x in enumerate(["▁a", "▁", "a", "b", "ab", "▁ab"])}
    rng = np.random.default_rng(2)
    m = language.LanguageModel(language.Vocabulary(vocab), ["x", "y"], np.vstack([rng.random((6, 2)), np.full((1, 2), language.RARE)]), np.zeros(2))

    def total(s):
        if not s:
            return np.ones(2)
        out = np.zeros(2)
        for p, i in vocab.items():
            if s.startswith(p):
                out = out + m.table[i] * total(s[len(p) :])
        if s[0] not in vocab:
            out = out + m.table[-1] * total(s[1:])
        return out

    for w in ("ab", "abba", "aqb", "b"):
        assert np.allclose(m.word(w), np.log(total("▁" + w)))


def test_learning_against_enumeration():
    """One round of expectation-maximisation: expected counts of pieces over all ways to cut each word."""
    pieces = {x: i for i, x in enumerate(["▁", "a", "b", "ab", "▁a"])}
    words = {"x": {"ab": 3, "aab": 2}, "y": {"b": 1, "aqa": 4}}

    def ways(s):
        if not s:
            return [[]]
        out = [[p, *w] for p in pieces if s.startswith(p) for w in ways(s[len(p) :])]
        return out if s[0] in pieces else out + [["?", *w] for w in ways(s[1:])]

    seen = np.zeros((6, 2))
    for k, lang in enumerate(("x", "y")):
        for w, n in words[lang].items():
            cuts = [(c, math.prod(language.RARE if p == "?" else 0.2 for p in c)) for c in ways("▁" + w)]
            for c, q in cuts:
                for p in c:
                    if p != "?":
                        seen[pieces[p], k] += n * q / sum(q for _, q in cuts)
    pooled = seen.sum(axis=1, keepdims=True) + 0.1
    pooled /= pooled.sum()
    want = (seen + 50 * pooled) / (seen.sum(axis=0) + 50)
    languages, table = language.learn(words, language.Vocabulary(pieces), rounds=1)
    assert languages == ["x", "y"] and np.allclose(table[:-1], want[:-1])


def test_language_of_foreign_letters_and_long_words(spark):
    tokens = pytest.importorskip("public_tokenizers")
    gothic, long = "\U00010330\U00010331" * 40, "thing" * 30_000
    rows = [(i, f"the thing and other {'words' * (i % 3)} {gothic if i == 2 else ''}", "en") for i in range(40)]
    rows += [(i, "und das ist nicht schön", "de") for i in range(40, 80)]
    rows += [(100, gothic, None), (101, f"the thing {gothic}", None), (102, long + " the and " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict(df, language.fit(df, tokens.path("piece_bpe_32k.model"))).collect()}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[101].lang_pred == got[102].lang_pred == "en"


def test_language_held_out(spark):
    tokens = pytest.importorskip("public_tokenizers")
    rng = random.Random(1)
    kinds = {"aa": ["the", "ing", "ther", "and"], "bb": ["schen", "und", "lich", "ung"], "cc": ["ción", "ado", "que", "los"]}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=rng.randrange(1, 3))) for _ in range(12)), k) for i in range(300) for k in [sorted(kinds)[i % 3]]]
    rows += [(300, None, "aa"), (301, "12 34 !", None), (302, "", "bb"), (None, "the and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict(df, language.fit(df, tokens.path("piece_bpe_32k.model"))).collect()}
    assert [got[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3
    held = [i for i in range(300) if got[i].held_out]
    assert len(held) > 50 and all(got[i].lang_pred == rows[i][2] for i in held)
    empty = language.predict(df, language.fit(df.limit(0), tokens.path("piece_bpe_32k.model")))
    assert {r.lang_pred for r in empty.collect()} == {"und"}
    assert math.isclose(max(r.score for r in got.values()), 1, abs_tol=0.1)


def test_signs_are_no_letters():
    from sleuthgrid.llm.language import words_of

    assert words_of("½ 12 ² ① Ⅷ _ 3") == []
    assert words_of("Aé½b x² Ⅷth ßÜ 漢字1") == ["aé", "b", "x", "th", "ßü", "漢字"]


def test_runs_are_scored_once_as_whole_texts(monkeypatch):
    """Sums over shared beginnings equal those over each word's own lattice, runs between white space hold the words of the text, and a run is cut once."""
    pa = pytest.importorskip("pyarrow")
    rng = random.Random(11)
    pieces = {x: i for i, x in enumerate(["▁", "▁a", "▁ab", "a", "b", "ab", "bab", "ς", "σ", "ba", "é", "baba"])}
    vocab = language.Vocabulary(pieces)
    table = np.random.default_rng(5).random((len(pieces) + 1, 3)) / 4
    table[-1] = language.RARE
    m = language.LanguageModel(vocab, ["x", "y", "z"], table, np.log(np.array([0.5, 0.3, 0.2])))
    some = ["".join(rng.choice("aabbéq\U00010330") for _ in range(rng.randrange(1, 12) if i % 9 else 95)) for i in range(300)]
    got = m.words(some)
    for word, own in zip(some, got):
        want = sum(np.log(language.forward(vocab.lattice([p], len(p)), 1, len(p), m.scaled)[-1, 0]) - len(p) * math.log(language.FACTOR) for p in language.parts_of(word))
        assert np.allclose(own, want, rtol=1e-12)
    gaps = [" ", "\n", "\x1c", "\x85", "　", "\xa0", " ", "\t ", "-", "​", "·"]
    texts = ["".join(rng.choice(["ab", "ΑΣ", "Σ", "baBa", "é½b", "12", "İ", "a_b"]) + rng.choice(gaps) for _ in range(40)) for _ in range(50)] + ["", None, "12 ½ _", "ab"]
    texts += texts
    cut = []
    whole = language.words_of
    monkeypatch.setattr(language, "words_of", lambda x: cut.append(x) or whole(x))
    for most in (1_000_000, 20):
        cut.clear()
        batches = [pa.record_batch([pa.array(texts[i : i + 30])], names=["text"]) for i in range(0, len(texts), 30)]
        rows = [r for b in language._predict(m, most=most, run_length=50)(iter(batches)) for r in b.to_pylist()]
        assert len(cut) == len(set(cut)) or most == 20
        for text, r in zip(texts, rows, strict=True):
            words = whole(text or "")
            total = m.prior + m.words(words).sum(axis=0)
            assert r["lang_pred"] == (m.languages[int(total.argmax())] if words else "und")
            assert math.isclose(r["score"], 1 / np.exp(total - total.max()).sum() if words else 0, rel_tol=1e-9)
