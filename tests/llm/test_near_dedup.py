import random

import corpus_pipeline
from sleuthgrid.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(4000)}" for _ in range(80)) for _ in range(n)]


def _near(text):
    return text.rsplit(" ", 1)[0] + " changed"


def test_null_and_repeated_ids(spark):
    t = _texts(11, 7)
    rows = [
        (None, t[0]), (None, t[1]), (None, t[1]), (None, t[2]),  # three unrelated texts without id, one of them twice
        (5, _near(t[0])), (6, _near(t[1])), (7, t[2]),  # near and exact copies of them
        (8, t[3]), (8, t[4]), (8, t[4]), (9, _near(t[4])),  # one id, two texts
        (3, t[5]), (10, _near(t[5])), (10, t[6]),  # an id whose first text is a copy and whose other is alone
        (None, None), (11, ""),
    ]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], SCHEMA)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.stage_near_dedup(spark, docs, "").collect()), key=str)
    assert kept == sorted([(None, t[0]), (None, t[1]), (None, t[2]), (8, t[3]), (8, t[4]), (3, t[5]), (10, t[6]), (None, None)], key=str)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows) and len({r.group_key for r in got}) == 8
    group = {r.doc_id: r.group_id for r in got}
    assert [group[i] for i in (None, 5, 6, 7, 8, 9, 3, 11)] == [None, None, None, None, 8, 8, 3, None]
    assert len({r.group_key for r in got if r.doc_id is None}) == 4 and sorted(r.group_id for r in got if r.doc_id == 10) == [3, 10]


def test_rows_that_differ_elsewhere(spark):
    t = _texts(12, 1)[0]
    docs = spark.createDataFrame([(1, t, "fr", "b", 5), (1, t, "en", "c", 5), (1, t, None, "a", 5)], SCHEMA)
    assert [(r.doc_id, r.lang, r.source) for r in corpus_pipeline.stage_near_dedup(spark, docs, "").collect()] == [(1, None, "a")]
