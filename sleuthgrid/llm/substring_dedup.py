"""Removal of repeated word windows through a log-structured fingerprint index.

The index is a list of immutable runs, each a Parquet table sorted by
fingerprint. A batch of documents is sketched, its fingerprints are
merge-joined with the runs of all batches before it, repeated windows are
verified, and what the batch adds is appended as a run; runs are compacted
when there are too many and another batch comes.

A window's fingerprint is the smallest hash among the short word sequences
inside it, so equal windows always have the same one at the same place, and
neighbouring windows mostly share it. The windows of a document that share one
form a stretch: a row of the sketch, with the fingerprint and a 128-bit BLAKE2
digest of the stretch's own words. Stretches of the same words are a class, of
which only the first is kept in the index: all windows of the others start
earlier there. Where a fingerprint has several classes, as at the ends of a
repeated passage, the windows of each class's first stretch are read again
from the texts, old and new, and compared one by one, by the same digest of
their words. Fingerprints only choose what is compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, order_bounds, released, schema_of, spread_join, texts
from .hashing import window_hashes, word_bounds, word_hashes

SHORT = 6
#: Stands for a null doc_id: it comes before all others.
NULL_ID = -(2**63)
#: Rows that a task holds before it hands them on.
ROWS_AT_ONCE = 50_000


def window_fingerprints(words: np.ndarray, window: int, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the smallest hash of a short sequence inside it, and where that starts (the first of equal ones)."""
    best = window_hashes(words, short, 5)
    wide = window - short + 1
    if len(best) < wide:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    place, have = np.arange(len(best)), 1
    while have < wide:  # the least of two overlapping spans is the least of both
        step = min(have, wide - have)
        less = best[step:] < best[:-step]
        best, place = np.where(less, best[step:], best[:-step]), np.where(less, place[step:], place[:-step])
        have += step
    return best, place


def plain_words(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and the start and end of each."""
    # bytes.split() parts words at the same bytes as word_bounds
    data = b" ".join(text.split())
    return data, *word_bounds(data)


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two signed 64-bit numbers of each stretch of bytes: its 128-bit digest."""
    make = hashlib.blake2b
    return np.frombuffer(b"".join([make(data[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), "<i8").reshape(-1, 2)


def _in_slices(rows, names: list[str]):
    """Record batches of lists of arrays, of ROWS_AT_ONCE rows or a little more."""
    held, n = [], 0
    for columns in rows:
        held.append(columns)
        n += len(columns[0])
        if n >= ROWS_AT_ONCE:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)
            held, n = [], 0
    if held:
        yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)


def _stretches(window: int):
    """Of each text, the stretches of windows that share a fingerprint."""

    def rows(batches):
        for batch in batches:
            ids, keys = batch.column("id").to_numpy(), batch.column("tkey").to_numpy()
            for i, text in enumerate(texts(batch, "text")):
                data, starts, ends = plain_words(text)
                best, place = window_fingerprints(word_hashes(data, bounds=(starts, ends)), window)
                if not len(best):
                    continue
                first = np.append(0, np.flatnonzero(np.diff(place)) + 1)
                count = np.diff(np.append(first, len(place)))
                d = digests(data, starts[first], ends[first + count + window - 2])
                n = len(first)
                yield best[first].view(np.int64), d[:, 0], d[:, 1], np.full(n, ids[i]), np.full(n, keys[i]), first.astype(np.int32), count.astype(np.int32)

    return released(lambda batches: _in_slices(rows(batches), ["m", "d1", "d2", "id", "tkey", "pos", "n_windows"]))


def _windows(window: int):
    """Of each text, every window of the stretches listed in places."""

    def rows(batches):
        for batch in batches:
            ids, keys, new = (batch.column(c).to_pylist() for c in ("id", "tkey", "is_new"))
            for i, text in enumerate(texts(batch, "text")):
                data, starts, ends = plain_words(text)
                first, count = (batch.column("places")[i].values.field(c).to_numpy().astype(np.int64) for c in ("pos", "n_windows"))
                at = np.unique(np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum()))
                d, n = digests(data, starts[at], ends[at + window - 1]), len(at)
                yield d[:, 0], d[:, 1], np.full(n, ids[i]), np.full(n, keys[i]), at.astype(np.int32), np.full(n, new[i])

    return released(lambda batches: _in_slices(rows(batches), ["d1", "d2", "id", "tkey", "pos", "is_new"]))


def _keep(window: int, with_text: bool):
    def run(batches):
        for batch in batches:
            found = batch.column("gone")
            n_words, n_removed, sha, kept = [], [], [], []
            for i, text in enumerate(texts(batch, "text")):
                if not found[i].is_valid or not len(found[i]):
                    words = text.split()
                    n_words.append(len(words))
                    n_removed.append(0)
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    if with_text:
                        kept.append(text.decode())
                    continue
                data, starts, ends = plain_words(text)
                gone = np.zeros(len(starts) + 2, np.int64)
                first, n = (found[i].values.field(c).to_numpy() for c in ("pos", "n_windows"))
                np.add.at(gone, first + 1, 1)
                np.add.at(gone, first + n + window, -1)
                stay = np.cumsum(gone) == 0  # of each word, between two that don't
                stay[[0, -1]] = False
                edge = np.flatnonzero(np.diff(stay))
                left = b" ".join([data[a:b] for a, b in zip(starts[edge[::2]].tolist(), ends[edge[1::2] - 1].tolist(), strict=True)])
                n_words.append(len(starts))
                n_removed.append(int(len(starts) - stay.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept.append(left.decode())
            arrays = [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["row", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.record_batch(arrays, names=names)

    return released(run)


class FingerprintIndex:
    """Sorted immutable runs of the first stretch of each class in all batches so far.

    Runs are compacted into one when there are more than fanout and a batch is
    added to them.
    """

    def __init__(self, spark: SparkSession, window: int = 20, fanout: int = 2):
        if window < SHORT:
            raise ValueError(f"window must be at least {SHORT}")
        self.ws, self.window, self.fanout = Workspace(spark, "fingerprints"), window, fanout
        self.runs: list[tuple[str, DataFrame]] = []
        self.made = 0

    def _append(self, run: DataFrame) -> None:
        self.made += 1
        name = f"run-{self.made}"
        self.runs.append((name, self.ws.write(run.sortWithinPartitions("m", "d1", "d2"), name)))

    def compact(self) -> None:
        """Merge all runs into one."""
        self.made += 1
        name, old = f"run-{self.made}", self.runs
        self.runs = [(name, self.ws.write(self.history().repartition("m", "d1", "d2").sortWithinPartitions("m", "d1", "d2"), name))]
        self.ws.drop(*[n for n, _ in old])

    def history(self) -> DataFrame | None:
        out = None
        for _, run in self.runs:
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, batch: DataFrame, so_far: DataFrame, last: bool = False) -> DataFrame:
        """Find the repeated windows of batch (id, text, tkey) and add it: id, tkey, gone (stretches of windows to remove).

        so_far: the documents of this batch and those before it, from which
        windows are read again. Every id of batch must be greater than those of
        earlier batches. last: no batch follows, so what this one adds isn't
        written.
        """
        if len(self.runs) > self.fanout:
            self.compact()
        ws, k, key = self.ws, self.made, ["m", "d1", "d2"]
        rows = ws.write(batch.select("id", "tkey", "text").mapInArrow(_stretches(self.window), schema_of("m long, d1 long, d2 long, id long, tkey long, pos int, n_windows int")), f"stretches-{k}")
        classes = rows.groupBy(*key).agg(F.min(F.struct("id", "pos", "tkey", "n_windows")).alias("first"), F.count(F.lit(1)).alias("n"))
        past = self.history()
        if past is None:
            classes = classes.withColumn("known", F.lit(False))
        else:
            old = past.select(*key, F.struct("id", "pos", "tkey", "n_windows").alias("old"))
            classes = classes.join(old.hint("merge"), key, "left").select(*key, F.coalesce("old", "first").alias("first"), "n", F.col("old").isNotNull().alias("known"))
        classes = ws.write(classes, f"classes-{k}")
        # fingerprints to which this batch adds a class and that have another
        added = classes.filter("not known").groupBy("m").agg(F.count(F.lit(1)).alias("n_new"))
        if past is not None:
            added = added.join(past.groupBy("m").agg(F.lit(1).alias("before")).hint("merge"), "m", "left")
        mixed = ws.write(added.filter("n_new > 1" + " or before = 1" * (past is not None)).select("m"), f"mixed-{k}")
        shown = classes.join(mixed.withColumn("mixed", F.lit(True)).hint("merge"), "m", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False))).filter("n > 1 or known or mixed")
        shown = ws.write(shown, f"shown-{k}")
        later = F.struct("id", "pos") > F.struct("first.id", "first.pos")
        hits = spread_join(rows, shown, key, "n").select("id", "tkey", "pos", "n_windows", later.alias("later"), (F.col("mixed") & ~F.col("known")).alias("open"))
        hits = ws.write(hits.filter("later or open"), f"hits-{k}")
        ws.drop(f"stretches-{k}", f"shown-{k}")
        # windows of first stretches whose fingerprint has several classes
        firsts = hits.filter("not later").select("id", "tkey", "pos", "n_windows", F.lit(True).alias("is_new"))
        if past is not None:
            firsts = firsts.unionByName(past.join(mixed.hint("merge"), "m", "left_semi").select("id", "tkey", "pos", "n_windows", F.lit(False).alias("is_new")))
        places = firsts.groupBy("id", "tkey").agg(F.collect_set(F.struct("pos", "n_windows")).alias("places"), F.max("is_new").alias("is_new"))
        # the places in a task's texts are fewer than their words, so it is those that are hashed, and texts needn't be sorted
        windows = so_far.select("id", "tkey", "text").join(places.hint("shuffle_hash"), ["id", "tkey"]).mapInArrow(_windows(self.window), schema_of("d1 long, d2 long, id long, tkey long, pos int, is_new boolean"))
        windows = ws.write(windows, f"windows-{k}")
        least = ws.write(windows.groupBy("d1", "d2").agg(F.min(F.struct("id", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), f"least-{k}")
        single = spread_join(windows.filter("is_new"), least, ["d1", "d2"], "n").filter(later).select("id", "tkey", "pos", F.lit(1).alias("n_windows"))
        gone = hits.filter("later").select("id", "tkey", "pos", "n_windows").unionByName(single)
        gone = ws.write(gone.groupBy("id", "tkey").agg(F.collect_set(F.struct("pos", "n_windows")).alias("gone")), f"gone-{k}")
        if not last:
            self._append(classes.filter("not known").select(*key, "first.*"))
        ws.drop(f"classes-{k}", f"mixed-{k}", f"hits-{k}", f"windows-{k}", f"least-{k}")
        return gone


def remove_repeats(docs: DataFrame, window: int = 20, batches: int = 3, with_text: bool = False) -> DataFrame:
    """Remove every word covered by a window of words that also starts earlier.

    Adds n_words, n_removed, kept_sha256 (and kept_text: the text itself where
    nothing is removed, else the kept words joined by one space) to the columns
    of docs, without text. Documents come in batches of ascending doc_id. A
    null text has no words; texts of under window words lose nothing, however
    long texts may be; a null doc_id comes before all others; rows that share a
    doc_id stand at one place, so of these neither is earlier than the other
    where they start a window at the same word; an empty table gives no rows;
    columns that clash with added ones are replaced, any others stay as they
    are, whatever their names.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c.lower() not in {"text", "n_words", "n_removed", "kept_sha256", "kept_text"}]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.struct(*others).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), text.alias("text"), F.xxhash64(text).alias("tkey"))
    plain = whole.select("id", "tkey", "text")
    index = FingerprintIndex(spark, window)
    cuts = order_bounds(plain.select("id"), "id", batches)
    found = None
    for i, low in enumerate(cuts):
        so_far = plain.filter(F.col("id") < cuts[i + 1]) if i + 1 < len(cuts) else plain
        gone = index.add(so_far.filter(F.col("id") >= low), so_far, last=i + 1 == len(cuts))
        found = gone if found is None else found.unionByName(gone)
    whole = whole.withColumn("gone", F.lit(None).cast("array<struct<pos:int,n_windows:int>>")) if found is None else whole.join(found.hint("shuffle_hash"), ["id", "tkey"], "left")
    made = schema_of("n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    schema = T.StructType([whole.schema["row"], *made.fields])
    return whole.select("row", "text", "gone").mapInArrow(_keep(window, with_text), schema).select("row.*", *made.names)


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
