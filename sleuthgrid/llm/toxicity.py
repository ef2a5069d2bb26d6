"""Toxic passages as maximum-scoring segments of token log-odds.

Learning. For each word and each of its prefixes of 4 to 6 letters (words are
inflected), the share of toxic and of clean training texts that hold it, each
under a Dirichlet prior centred on the share in both together. A token's score
is the largest log-odds of its word and prefixes, less a number of standard
errors, so that rare words don't count, and less LEAST; a token that has none
over that costs DRIFT.

Scanning. One linear pass finds all maximal segments of a positive score:
segments that no longer one with a better score contains and no shorter one
improves. A long run of costs is a single step.

Calibration. Under the scores of clean texts, the best segment of a text of n
tokens follows an extreme-value law: E = K n exp(-lambda S) segments of score S
or more are expected by chance. lambda solves sum p(s) exp(lambda s) = 1, K is
fitted to the best segments of clean texts, the evidence of a text is the sum
over its significant segments, and a logistic curve of it, fitted on texts
scored by a model that hasn't seen them, gives a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, released, schema_of, texts

WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
#: Chosen by the loss on training rows alone, each scored by a model that hasn't seen it (Model.loss).
PRIOR = 40.0
ERRORS = 2.0
DRIFT = 0.5
LEAST = 0.5
#: Bounds of the training sample: texts of each label.
MOST_TOXIC, MOST_CLEAN = 2000, 4000


def features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}~" for n in PREFIXES if len(word) > n]]


def segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last token) of tokens that cost drift but for those at places, which have scores over 0.

    Linear in the number of places: every candidate holds the number of the
    nearest one before it with a smaller left sum, and a search steps from one
    of these to the next, so what it passes over is never looked at again.
    """
    held: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, nearest with a smaller sum before
    total, at = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        total -= drift * (place - at)
        left, right, first, j = total, total + score, place, len(held) - 1
        while True:
            while j >= 0 and held[j][0] >= left:
                j = held[j][4]
            if j < 0 or held[j][1] >= right:
                break
            # joined with j, which takes in all between; its own link leads on
            left, first, link = held[j][0], held[j][2], held[j][4]
            del held[j:]
            j = link
        held.append((left, right, first, place, j))
        total, at = right, place + 1
    return [(b - a, i, j) for a, b, i, j, _ in held]


class Model:
    def __init__(self, weights: dict[str, float], decay: float = 1.0, scale: float = 1.0, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.decay, self.scale, self.slope, self.offset = weights, decay, scale, slope, offset
        self.loss = math.nan

    def positives(self, text: str, cache: dict[str, float]) -> tuple[list[int], list[float], int]:
        """Places and scores of the tokens with a score over 0, and the number of tokens."""
        words = WORD.findall(text.lower())
        for w in set(words):
            if w not in cache:
                if len(cache) > 200_000:
                    cache.clear()
                cache[w] = max(self.weights.get(f, 0.0) for f in features(w))
        places, scores = [], []
        for i, w in enumerate(words):
            s = cache.get(w)
            if s is None:  # the cache was emptied under way
                s = cache[w] = max(self.weights.get(f, 0.0) for f in features(w))
            if s > 0:
                places.append(i)
                scores.append(s)
        return places, scores, len(words)

    def evidence(self, found: list[tuple[float, int, int]], n: int) -> float:
        """Sum over segments of how far -ln E lies over 0, of which the best counts in full even below."""
        if not found:
            return 0.0
        logs = sorted((self.decay * s - math.log(self.scale * max(1, n)) for s, _, _ in found), reverse=True)
        return math.log1p(math.exp(min(logs[0], 50))) + max(0.0, logs[0] - 50) + sum(max(0.0, x) for x in logs[1:])

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * math.log1p(evidence) + self.offset))))


def _presence(batches):
    """Feature, label, fold of every text, once each."""
    for batch in batches:
        label, fold = batch.column("toxic").to_pylist(), batch.column("fold").to_pylist()
        out = Counter()
        for i, text in enumerate(texts(batch, "text")):
            out.update((f, label[i], fold[i]) for f in {f for w in set(WORD.findall(text.decode().lower())) for f in features(w)})
        if out:
            yield pa.record_batch([pa.array([k[0] for k in out]), pa.array([k[1] for k in out], pa.int32()), pa.array([k[2] for k in out], pa.int32()), pa.array(list(out.values()), pa.int64())], names=["f", "toxic", "fold", "n"])


def _log_odds(a, b, n1, n0, prior: float, errors: float, least: float):
    """Lower bound of the log-odds of toxic and clean share, less least, as columns."""
    q = prior * (a + b) / (n1 + n0)
    return F.log((a + q) / (n1 + prior)) - F.log((b + q) / (n0 + prior)) - errors * F.sqrt(1 / (a + q) + 1 / (b + q)) - least


def _clean_scores(models: dict[int, Model]):
    """Of clean training texts, each under the model that hasn't seen it: tenths of token scores with their counts, and best segments (score, n) with a tenth of -1."""

    def run(batches):
        caches = {k: {} for k in models}
        for batch in batches:
            fold, out, best = batch.column("fold").to_pylist(), Counter(), []
            for i, text in enumerate(texts(batch, "text")):
                places, scores, n = models[fold[i]].positives(text.decode(), caches[fold[i]])
                out.update(round(s * 10) for s in scores)
                best.append((max((s for s, _, _ in segments(places, scores)), default=0.0), n))
            yield pa.record_batch([pa.array([*out, *[-1] * len(best)], pa.int32()), pa.array([*out.values(), *[n for _, n in best]], pa.int64()), pa.array([*[0.0] * len(out), *[s for s, _ in best]], pa.float64())], names=["tenth", "n", "best"])

    return released(run)


def _evidence(models: dict[int, Model]):
    """Of training texts, each under the model that hasn't seen it: label and evidence."""

    def run(batches):
        caches = {k: {} for k in models}
        for batch in batches:
            fold, out = batch.column("fold").to_pylist(), []
            for i, text in enumerate(texts(batch, "text")):
                places, scores, n = models[fold[i]].positives(text.decode(), caches[fold[i]])
                out.append(models[fold[i]].evidence(segments(places, scores), n))
            yield pa.record_batch([batch.column("toxic"), pa.array(out, pa.float64())], names=["toxic", "evidence"])

    return released(run)


def _decay(counts: Counter, clean_tokens: int) -> float:
    """lambda: the positive root of sum p(s) exp(lambda s) = 1 for the token scores of clean texts."""
    hits = dict(counts) or {80: 0}
    top = max(hits)
    hits[top] = hits.get(top, 0) + 0.5
    total = clean_tokens + 1.0
    rest = 1 - sum(hits.values()) / total

    def excess(x: float) -> float:
        return rest * math.exp(-DRIFT * x) + sum(n / total * math.exp(min(500, x * s / 10)) for s, n in hits.items()) - 1

    low, high = 1e-4, 1e-3
    while excess(high) < 0 and high < 50:
        low, high = high, high * 1.5
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope (0 at least) and offset, by damped Newton steps with a weak prior that keeps separable data finite."""
    a = np.stack([x, np.ones(len(x))], axis=1)
    beta = np.array([1.0, -2.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        grad = a.T @ (w * (y - p)) - 1e-2 * beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += step * min(1, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 2, prior: float = PRIOR, errors: float = ERRORS, least: float = LEAST) -> Model:
    """Learn from rows of docs with a label whose crc32(doc_id) mod 4 is not held_out.

    At most MOST_TOXIC and MOST_CLEAN different texts are used, taken in the
    order of a hash of doc_id; all their words, segments and scores count.
    Without rows of both labels the model knows no word and gives every text
    the same low score. The model's loss is the mean log loss of training
    texts, scored by models that haven't seen them.
    """
    spark = docs.sparkSession
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(F.crc32(F.col("doc_id").cast("string")) % 4 != held_out)
    order = F.xxhash64("doc_id")
    picked = known.filter("toxic = 1").orderBy(order, "doc_id").limit(MOST_TOXIC).unionByName(known.filter("toxic = 0").orderBy(order, "doc_id").limit(MOST_CLEAN))
    ids = picked.collect()  # at most MOST_TOXIC + MOST_CLEAN pairs of numbers
    small = F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id long, toxic int"))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(small, "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    ws = Workspace(spark, "toxicity")
    sample = ws.write(sample.select("text", "toxic", F.pmod("h", F.lit(2)).cast("int").alias("fold")), "sample")
    size = {(r.toxic, r.fold): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
    n1, n0 = sum(v for k, v in size.items() if k[0]), sum(v for k, v in size.items() if not k[0])
    if not n1 or not n0:
        return Model({}, offset=-4.0)
    part = lambda t, f: F.sum(F.when((F.col("toxic") == t) & (F.col("fold") == f), F.col("n")).otherwise(0))
    counts = sample.mapInArrow(_presence, schema_of("f string, toxic int, fold int, n long")).groupBy("f").agg(part(1, 0).alias("a0"), part(1, 1).alias("a1"), part(0, 0).alias("b0"), part(0, 1).alias("b1")).filter("a0 + a1 >= 2")
    odds = lambda a, b, x, y: _log_odds(a, b, x, y, prior, errors, least)
    w = counts.select("f", odds(F.col("a0") + F.col("a1"), F.col("b0") + F.col("b1"), n1, n0).alias("all"), *[odds(F.col(f"a{k}"), F.col(f"b{k}"), max(1, size.get((1, k), 0)), max(1, size.get((0, k), 0))).alias(f"only{k}") for k in (0, 1)])
    rows = w.filter("`all` > 0 or only0 > 0 or only1 > 0").collect()  # words of the toxic texts of the bounded sample
    weights = {k: {r.f: r[k] for r in rows if r[k] is not None and r[k] > 0} for k in ("all", "only0", "only1")}
    model, unseen = Model(weights["all"]), {0: Model(weights["only1"]), 1: Model(weights["only0"])}
    seen = sample.filter("toxic = 0").mapInArrow(_clean_scores(unseen), schema_of("tenth int, n long, best double")).groupBy("tenth", F.when(F.col("tenth") < 0, F.col("best")).alias("best"), F.when(F.col("tenth") < 0, F.col("n")).alias("size")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("times")).collect()
    best = [(r.best, r["size"], r.times) for r in seen if r.tenth < 0 and r["size"]]
    model.decay = _decay(Counter({r.tenth: r.n for r in seen if r.tenth >= 0}), sum(r.n for r in seen if r.tenth < 0))
    if best:
        mean = sum(t * (model.decay * s - math.log(n)) for s, n, t in best) / sum(t for _, _, t in best)
        model.scale = math.exp(min(20.0, max(-20.0, mean - 0.5772)))
    for m in unseen.values():
        m.decay, m.scale = model.decay, model.scale
    rated = sample.mapInArrow(_evidence(unseen), schema_of("toxic int, evidence double")).collect()  # two numbers for each text of the bounded sample
    x, y = np.array([math.log1p(r.evidence) for r in rated]), np.array([float(r.toxic) for r in rated])
    model.slope, model.offset = _logistic(x, y, np.ones(len(x)))
    p = np.clip([model.probability(r.evidence) for r in rated], 1e-9, 1 - 1e-9)
    model.loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    ws.drop("sample")
    return model


def _score(model: Model):
    def run(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            out = [[] for _ in range(4)]
            for text in texts(batch, "text"):
                places, scores, n = model.positives(text.decode(), cache)
                found = segments(places, scores)
                _, first, last = max(found, default=(0.0, -1, -1))
                p = model.probability(model.evidence(found, n))
                for x, y in zip(out, (p, len(found), first, last), strict=True):
                    x.append(y)
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*[batch.column(c) for c in names], pa.array(out[0], pa.float64()), *[pa.array(x, pa.int64()) for x in out[1:]]], names=[*names, "score", "n_segments", "first_token", "last_token"])

    return released(run)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_segments, and the first and last token of the best segment (-1 if there is none).

    A null or empty text has the score of no evidence; a long one is read whole.
    A null doc_id isn't held out. Rows repeat in the result as in the table, and
    other columns are ignored; an empty table gives no rows.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    out = base.mapInArrow(_score(model), schema_of(f"doc_id {kind}, score double, n_segments long, first_token long, last_token long"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_segments", "first_token", "last_token")


def _clean(model: Model, threshold: float):
    def run(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            keep = []
            for i, text in enumerate(texts(batch, "text")):
                places, scores, n = model.positives(text.decode(), cache)
                if model.probability(model.evidence(segments(places, scores), n)) < threshold:
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return released(run)


def clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score under threshold, as they are."""
    return docs.mapInArrow(_clean(model, threshold), docs.schema)


def _passages(model: Model, others: list[str], expected: float):
    def run(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            rows = [[] for _ in range(7)]
            for i, text in enumerate(texts(batch, "text")):
                text = text.decode()
                places, scores, n = model.positives(text, cache)
                found = [(s, a, b, e) for s, a, b in segments(places, scores) if (e := model.scale * n * math.exp(-model.decay * s)) <= expected]
                if not found:
                    continue
                spans = [m.span() for m in WORD.finditer(text)] if len(text.lower()) == len(text) else None
                for s, a, b, e in found:
                    for x, y in zip(rows, (i, s, e, a, b, spans[a][0] if spans else None, spans[b][1] if spans else None), strict=True):
                        x.append(y)
            if rows[0]:
                own = batch.take(pa.array(rows[0]))
                kinds = [pa.float64(), pa.float64(), *[pa.int64()] * 4]
                yield pa.record_batch([*[own.column(c) for c in others], *[pa.array(x, k) for x, k in zip(rows[1:], kinds, strict=True)]], names=[*others, "segment_score", "expected", "first_token", "last_token", "start", "stop"])

    return released(run)


def passages(docs: DataFrame, model: Model, keys: tuple[str, ...] = ("doc_id",), expected: float = 0.01) -> DataFrame:
    """Every significant toxic passage: the key columns, segment_score, expected, first_token, last_token, start, stop.

    A passage is a maximal segment of which chance would give at most expected
    in a clean text of its text's length. start and stop are code points; they
    are null where lower case changes a text's length. Null, empty and clean
    texts have no row.
    """
    base = docs.select(*keys, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = schema_of("segment_score double, expected double, first_token long, last_token long, start long, stop long")
    return base.mapInArrow(_passages(model, list(keys), expected), T.StructType([*base.select(*keys).schema.fields, *made.fields]))
