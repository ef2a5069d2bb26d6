"""Passages of a benchmark in documents, by the q-gram lemma and banded alignment.

If a stretch of text is within k edits of an item of length L, the two share at
least t = L - q + 1 - k q of the item's q-grams, on diagonals (place in text
less place in item) that lie within k of each other. So q-gram hits are counted
in bands of 2k diagonals, each overlapping the next by k; bands with t hits or
more are regions, and each region is verified by an alignment that looks only
at the band. Texts are compared in lower case, by code points.

Before hits are spread to all items that hold a q-gram, places with too few
hits near them for any item are left out, which the same lemma allows. Hits
are spread some at a time, and of bands with enough of them those that follow
each other are one region, so that q-grams which repeat within an item or a
text cost neither memory nor an alignment for each band. A region is searched
for its best passage, and then before and after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, schema_of, texts
from .hashing import mix, odd_powers

Q, RATE = 10, 0.08
#: Characters of items that one pass over the documents looks for.
BLOCK_CHARS = 1_000_000
TABLE_BITS = 22
#: Hits that are spread to items at once.
SPREAD = 500_000


def points(text: str) -> np.ndarray:
    """Code points of the text in lower case; a character whose lower case is longer stays as it is."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(p: np.ndarray, q: int) -> np.ndarray:
    n = len(p) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    wide = p.astype(np.uint64)
    total = np.zeros(n, np.uint64)
    for j, m in enumerate(odd_powers(q, 3)):
        total += wide[j : j + n] * m
    return mix(total)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits, start and end of item within text on diagonals low to high; None if over most.

    Row by row over the item; a cell holds the edits and the start of the best
    path to it. Insertions along a row are a running minimum. The text is
    padded once, so that a row looks at one stretch of it.
    """
    width, n = high - low + 1, len(text)
    step = np.arange(width)
    big = len(item) + n + 1
    bits = (4 * width).bit_length()
    place = step - (step << bits)  # turns costs a into sortable a - step, then step
    at = low + step
    cost = np.where((at >= 0) & (at <= n), 0, big)
    start = at
    first, last = low, low + len(item) + width  # places of the text that any row looks at
    padded = np.full(last - first, 0xFFFFFFFF, np.uint32)
    a0, a1 = max(first, 0), min(last, n)
    if a0 < a1:
        padded[a0 - first : a1 - first] = text[a0:a1]
    down, shifted = np.empty(width, np.int64), np.zeros(width, np.int64)
    for i, point in enumerate(item.tolist()):
        left = -(low + i)  # the first cell whose end in the text is 1
        right = n - low - i  # the first cell whose end is over the text's
        a = cost + (padded[i : i + width] != point)
        np.add(cost[1:], 1, out=down[:-1])
        shifted[:-1] = start[1:]
        down[-1] = big
        if left > 0:
            a[:left] = big
            down[: left - 1] = big
        if right < width:
            a[max(right, 0) :] = big
            down[max(right, 0) :] = big
        s = np.where(down < a, shifted, start)
        np.minimum(a, down, out=a)
        src = np.minimum.accumulate((a << bits) + place) & ((1 << bits) - 1)
        cost = a[src]
        cost += step
        cost -= src
        if cost.min() > most:
            return None
        start = s[src]
    best = int(cost.argmin())
    return (int(cost[best]), int(start[best]), int(low + len(item) + best)) if cost[best] <= most else None


def whole(item: np.ndarray, text: np.ndarray) -> int:
    """Where text holds item without an edit; -1 if nowhere."""
    data, raw = text.tobytes(), item.tobytes()
    at = data.find(raw)
    while at >= 0 and at % 4:
        at = data.find(raw, at + 1)
    return at // 4 if at >= 0 else -1


class Items:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE):
        self.q = q
        self.ids, self.points, self.edits, self.least, self.short = [], [], [], [], []
        hashes, owner, place = [], [], []
        same: dict[bytes, list[int]] = {}  # items of equal text are looked for once
        for item_id, text in items:
            same.setdefault(points(text).astype("<u4").tobytes(), []).append(item_id)
        for raw, item_ids in same.items():
            p = np.frombuffer(raw, "<u4")
            if len(p) < q:
                if len(p):
                    self.short.append((item_ids, raw, len(p)))
                continue
            k = min(int(rate * len(p)), (len(p) - q) // q)
            n = len(self.ids)
            self.ids.append(item_ids)
            self.points.append(p)
            self.edits.append(k)
            self.least.append(len(p) - q + 1 - k * q)
            h = gram_hashes(p, q)
            hashes.append(h)
            owner.append(np.full(len(h), n, np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.owner = np.concatenate(owner)[order] if hashes else np.empty(0, np.int32)
        self.place = np.concatenate(place)[order] if hashes else np.empty(0, np.int32)
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        # classes of like length: fewest hits, and the widest stretch that holds them
        sizes = np.array([len(p) for p in self.points])
        self.classes = []
        for part in np.array_split(np.argsort(sizes), min(6, len(sizes))) if len(sizes) else []:
            self.classes.append((min(self.least[i] for i in part), max(int(sizes[i]) + self.edits[i] for i in part)))

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """item_id, start, end, edits of every passage; of passages of an item that overlap, the one of fewest edits."""
        p = points(text)
        for item_ids, raw, n in self.short:
            data, at = p.tobytes(), -1
            while (at := data.find(raw, at + 1)) >= 0:
                if at % 4 == 0:
                    yield from ((item_id, at // 4, at // 4 + n, 0) for item_id in item_ids)
        h = gram_hashes(p, self.q)
        if not len(h) or not len(self.keys):
            return
        near = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        if not len(near):
            return
        k = np.searchsorted(self.keys, h[near])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == h[near]
        pos, k = near[hit], k[hit]
        dense = np.zeros(len(pos), bool)
        for least, wide in self.classes:
            around = np.searchsorted(pos, pos + wide, "right") - np.searchsorted(pos, pos - wide)
            dense |= around >= least
        pos, k = pos[dense], k[dense]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, low, high in self._regions(pos, k):
            found.setdefault(i, []).extend(self._passages(p, self.points[i], low, high, self.edits[i]))
        for i, rows in found.items():
            kept: list[tuple[int, int, int]] = []
            for e, s, t in sorted(rows):
                if all(t <= s2 or s >= t2 for _, s2, t2 in kept):
                    kept.append((e, s, t))
            for e, s, t in kept:
                yield from ((item_id, s, t, e) for item_id in self.ids[i])

    def _regions(self, pos: np.ndarray, k: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Item, first and last diagonal of bands with enough hits, those that follow each other together."""
        shift = np.int64(1) << np.int64(40)
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.cumsum(self.count[k])
        first = 0
        while first < len(pos):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SPREAD, "right")))
            n = self.count[k[first:last]]
            flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[k[first:last]], n)
            owner = self.owner[flat].astype(np.int64)
            band = (np.repeat(pos[first:last], n) - self.place[flat]) // np.maximum(np.array(self.edits)[owner], 1)
            key = owner * shift + band + (shift >> 1)
            some, times = np.unique(np.concatenate([key, key - 1]), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, some]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, times]), len(keys)).astype(np.int64)
            first = last
        keys = keys[counts >= np.array(self.least)[keys // shift]] if len(keys) else keys
        cuts = np.flatnonzero(np.diff(keys) > 1) + 1
        for chain in np.split(keys, cuts) if len(keys) else []:
            i = int(chain[0] // shift)
            step = max(self.edits[i], 1)
            bands = (chain % shift - (shift >> 1)).tolist()
            most = max(2, len(self.points[i]) // (4 * step))  # an alignment's width is then about the item's length at most
            for j in range(0, len(bands), most):
                yield i, bands[j] * step, bands[min(j + most, len(bands)) - 1] * step + 2 * step

    @staticmethod
    def _passages(p: np.ndarray, item: np.ndarray, low: int, high: int, edits: int) -> Iterator[tuple[int, int, int]]:
        """edits, start, end of passages of item in p on diagonals low to high (and as far before as the edits reach)."""
        todo = [(max(0, low), min(len(p), high + len(item) + edits))]
        while todo:
            a, z = todo.pop()
            first, last = max(low - a - edits, -edits), min(high, z) - a
            if z - a < len(item) - edits or first > last:
                continue
            part = p[a:z]
            at = whole(item, part)
            best = (0, at, at + len(item)) if at >= 0 else align(item, part, first, last, edits)
            if best is not None:
                e, s, t = best
                yield e, s + a, t + a
                todo += [(a, a + s), (a + t, z)]


def _find(items: Items, others: list[str], made: list[str]):
    def run(batches):
        for batch in batches:
            rows = [[], [], [], [], []]
            for i, text in enumerate(texts(batch, "text")):
                for found in items.find(text.decode()):
                    for x, y in zip(rows, (i, *found), strict=True):
                        x.append(y)
            if rows[0]:
                own = batch.take(pa.array(rows[0]))
                yield pa.record_batch([*[own.column(c) for c in others], *[pa.array(x, pa.int64()) for x in rows[1:]]], names=[*others, *made])

    return released(run)


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most about most characters, so that no more is held or sent at once."""
    held, size = [], 0
    for r in benchmark.filter("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(r.text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def passages(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",), q: int = Q, rate: float = RATE) -> DataFrame:
    """Where documents hold items of a benchmark: the key columns, item_id, start and stop (code points), edits.

    Up to rate of an item's characters may be edited (fewer in items so short
    that the lemma would ask for no hit); items under q characters must match
    exactly; empty and null items and texts match nothing; items of equal text
    match alike, and long texts are read whole. The result has no row for clean
    documents; rows that repeat in docs repeat in it. A column whose name is
    that of a key column gets a line below after it.
    """
    made = []
    for name in ("item_id", "start", "stop", "edits"):
        while name in {k.lower() for k in keys}:
            name += "_"
        made.append(name)
    base = docs.select(*keys, F.col("text").cast("string").alias("text"))
    schema = T.StructType([*base.select(*keys).schema.fields, *schema_of(", ".join(f"{c} long" for c in made)).fields])
    out = None
    for block in blocks(benchmark):
        part = base.mapInArrow(_find(Items(block, q, rate), list(keys), made), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)
