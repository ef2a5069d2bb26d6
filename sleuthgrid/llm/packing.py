"""Packing documents into training sequences, as a cutting-stock problem.

Documents are cut into full pieces and one rest. What has to be packed is then
a histogram of at most SIZE lengths, whatever the corpus: a linear program over
patterns (how many pieces of each length share a sequence) whose columns are
generated by a knapsack over its duals. Patterns are rounded down; what they
leave, at most some pieces for each pattern, is packed exactly where lengths
fit and cut where they don't. Pieces are ranked within their length, and ranks
are dealt to the places of the patterns.

A sequence is padded to SIZE unless its length is a power of two, so that is
what a pattern costs.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, released, schema_of, texts
from .ranking import ranked
from .token_output import _byte_letters

SIZE = 1024
#: So many pieces of a pattern that leaves room are cut instead.
FEW = 32


def byte_encoder(path: str, most: int = 1_000_000, block: int = 1 << 20) -> Callable[[str], Iterator[bytes]]:
    """Encodes texts with a byte-level tokenizers file: the ids, in parts, as little-endian unsigned 32-bit integers.

    A single space or line break between two characters that aren't white
    space begins a new piece of the file's pattern, so texts are cut there;
    different words are encoded once, many at a time, by their ranks (the ids,
    if the file lists its merges in their order). Stretches with other white
    space go through the ranks whole, and texts that may name a special token
    through the file itself. The memory of words is emptied when it holds more
    than most.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        says = json.load(f)
    # fixed value: the pattern that byte-level vocabularies without one of their own use
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    back = {chr(letter): byte for byte, letter in _byte_letters().items() if byte != 0x20} | {chr(_space_letter()): 0x20}
    special = {t["content"] for t in says["added_tokens"]}
    ranks = {bytes(map(back.__getitem__, t)): i for t, i in says["model"]["vocab"].items() if t not in special}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in says["model"]["merges"]]
    before = says["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and says["normalizer"] is None
    plain = plain and all(says["model"]["vocab"].get(m) == 256 + i for i, m in enumerate(merges)) and len(ranks) == 256 + len(merges)
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if plain else None
    begins = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    begins[[i for t, i in ranks.items() if t[0] in b" \n"]] = True
    known: dict[str, bytes | None] = {}

    def whole(text: str) -> bytes:
        if fast is not None and not any(t in text for t in special):
            try:
                return np.array(fast.encode_ordinary(text), "<u4").tobytes()
            except Exception:  # a run that its pattern can't finish; the file's own can
                pass
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(new: list[str]) -> None:
        fit = []
        for unit in new:
            inner = unit[1:] if unit[:1] == "\n" else unit
            if not inner or inner[0].isspace() or inner[-1].isspace():
                known[unit] = None
            else:
                fit.append(unit)
        if not fit:
            return
        ids = np.frombuffer(whole("".join([u if u[0] == "\n" else " " + u for u in fit])), "<u4")
        at = np.flatnonzero(begins[ids])
        if len(at) != len(fit):
            known.update((u, whole(u if u[0] == "\n" else " " + u)) for u in fit)
            return
        data, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
        known.update((u, data[a:b]) for u, a, b in zip(fit, (4 * at).tolist(), ends, strict=True))

    def safe(text: str, at: int) -> int:
        while 0 <= (at := text.find(" ", at)) < len(text) - 1:
            if not text[at - 1].isspace() and not text[at + 1].isspace():
                return at
            at += 1
        return len(text)

    def encode(text: str) -> Iterator[bytes]:
        if fast is None or any(t in text for t in special):
            yield whole(text)
            return
        at = 0
        while at < len(text):
            end = safe(text, at + block) if len(text) - at > block else len(text)
            part, first = text[at:end], at == 0
            at = end
            units = part.replace("\n", " \n").split(" ")
            if len(known) > most:
                known.clear()
            head, rest = units[0], units[1:]
            if first and not head or head[-1:].isspace():
                yield whole(part)
                continue
            new = [u for u in set(rest) if u not in known]
            if new:
                learn(new)
            try:
                done = b"".join(map(known.__getitem__, rest))
            except TypeError:
                yield whole(part)
                continue
            yield (whole(head) + done) if head else done

    return encode


def _space_letter() -> int:
    """The letter that byte-level vocabularies write for a space: bytes that aren't printed take those from 256 on in turn."""
    return 256 + 0x20


# ---------------------------------------------------------------- patterns


def _cost(w: np.ndarray, size: int) -> np.ndarray:
    """Places that a sequence of w tokens takes."""
    w = np.asarray(w)
    return np.where((w & (w - 1)) == 0, w, size)


def _fit(left: np.ndarray, top: int, size: int, whole: bool) -> list[int] | None:
    """top with none, one or two lengths that fill a sequence exactly, those of which most is left."""

    def there(with_: list[int]) -> bool:
        found = [top, *with_]
        return not whole or all(left[x] >= found.count(x) for x in found)

    room = size - top
    if room == 0:
        return [top]
    if left[room] > 0 and there([room]):
        return [top, room]
    a = np.arange(1, room // 2 + 1)
    both = np.minimum(left[a], left[room - a])
    for i in np.argsort(-both, kind="stable")[:4]:
        if both[i] > 0 and there([int(a[i]), int(room - a[i])]):
            return [top, int(a[i]), int(room - a[i])]
    return [top] if top & (top - 1) == 0 else None


def first_patterns(demand: np.ndarray, size: int, whole: bool) -> tuple[list[tuple[dict[int, int], float]], np.ndarray]:
    """Patterns that each use up one length, the longest left first, and how often; and what is left.

    whole: how often is an integer, patterns are exact and lengths that don't
    fit are left; else everything is used up, so the patterns are a basis.
    """
    left, out = demand.astype(np.float64 if not whole else np.int64).copy(), []
    aside, own = np.zeros_like(left), set(np.flatnonzero(demand).tolist())
    while len(at := np.flatnonzero(left > 0)):
        top = int(at[-1])
        found = _fit(left, top, size, whole)
        if found is None and whole:
            aside[top], left[top] = left[top], 0
            continue
        pattern: dict[int, int] = {}
        for x in found or [top]:
            pattern[x] = pattern.get(x, 0) + 1
        room = size - top
        if found is None:  # fill as far as it goes, longest first
            while room > 0 and len(at := np.flatnonzero(left[: room + 1] > 0)):
                pattern[int(at[-1])] = pattern.get(int(at[-1]), 0) + 1
                room -= int(at[-1])
        times = min(left[x] // n if whole else left[x] / n for x, n in pattern.items())
        used = min(pattern, key=lambda x: left[x] / pattern[x])
        for x, n in pattern.items():
            left[x] = max(0, left[x] - n * times)
        if not whole:
            left[used] = 0
            own.discard(used)
        out.append((pattern, times))
    if not whole:  # those that ended together with another one have a column of their own too
        out += [({x: size // x}, 0.0) for x in sorted(own)]
    return out, aside


def _price(y: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most that pieces of exactly w tokens are worth, for each w, and the last piece of each: an unbounded knapsack."""
    worth, last = np.full(size + 1, -np.inf), np.zeros(size + 1, np.int64)
    worth[0] = 0
    for w in range(1, size + 1):
        k = int(np.searchsorted(lengths, w, "right"))
        if k:
            all_ = worth[w - lengths[:k]] + y[:k]
            last[w] = i = int(all_.argmax())
            worth[w] = all_[i]
    return worth, last


def patterns(histogram: dict[int, int], size: int = SIZE, gap: float = 1e-4, pivots: int = 3000) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often each is used, of least cost to within gap, for all pieces of the histogram (length to count).

    A bound on the cost comes from the duals (scaled to be feasible) or from
    the pieces' lengths. After so many pivots what was found is returned: it
    packs everything, if not at the least cost.
    """
    demand = np.zeros(size + 1)
    for x, n in histogram.items():
        demand[x] = n
    start, _ = first_patterns(demand, size, False)
    lengths = np.flatnonzero(demand)
    place = {int(x): i for i, x in enumerate(lengths)}
    m, need = len(lengths), demand[lengths]
    if not m:
        return []

    def column(pattern: dict[int, int]) -> np.ndarray:
        a = np.zeros(m)
        for x, n in pattern.items():
            a[place[x]] = n
        return a

    basis = [p for p, _ in start]
    matrix = np.stack([column(p) for p in basis], axis=1)
    cost = _cost((matrix.T @ lengths).astype(np.int64), size).astype(float)
    inverse = np.linalg.inv(matrix)
    x = np.maximum(inverse @ need, 0)
    bound, done = float(need @ lengths), 0
    sizes = _cost(np.arange(size + 1), size).astype(float)
    while cost @ x > bound * (1 + gap) and done < pivots:
        y = cost @ inverse
        worth, last = _price(y, lengths, size)
        ratio = worth[1:] / sizes[1:]
        bound = max(bound, float(need @ y) / max(1.0, float(ratio.max())))
        good = np.flatnonzero(worth[1:] - sizes[1:] > 1e-7) + 1
        if not len(good):
            break
        found = []
        for w in good[np.argsort(-ratio[good - 1])][:64]:
            pattern: dict[int, int] = {}
            rest = int(w)
            while rest:
                pattern[int(lengths[last[rest]])] = pattern.get(int(lengths[last[rest]]), 0) + 1
                rest -= int(lengths[last[rest]])
            found.append((pattern, column(pattern), sizes[w]))
        columns, prices = np.stack([c for _, c, _ in found], axis=1), np.array([p for *_, p in found])
        for _ in range(32):
            less = prices - (cost @ inverse) @ columns
            j = int(less.argmin())
            if less[j] > -1e-7 or done >= pivots:
                break
            turn = inverse @ columns[:, j]
            up = turn > 1e-9
            steps = np.full(m, np.inf)
            steps[up] = x[up] / turn[up]
            r = int(steps.argmin())
            t = steps[r]
            x -= t * turn
            x[r] = t
            np.maximum(x, 0, out=x)
            row = inverse[r] / turn[r]
            inverse -= np.outer(turn, row)
            inverse[r] = row
            basis[r], cost[r] = found[j][0], prices[j]
            done += 1
    return [(p, float(n)) for p, n in zip(basis, x, strict=True) if n > 1e-9]


def rounded(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Whole numbers of patterns, none with more pieces than there are, and the pieces that no pattern takes.

    Patterns are rounded down and then, by how much that took, once up where
    pieces are left for it; the rest is packed where lengths fit exactly. A
    pattern that leaves room isn't used if it has no more than FEW pieces in all.
    """
    left, out = np.zeros(size + 1, np.int64), []
    for x, n in histogram.items():
        left[x] = n
    solved = [(p, times, sum(x * n for x, n in p.items())) for p, times in patterns(histogram, size)]
    exact = [s for s in solved if int(_cost(np.array(s[2]), size)) == s[2]]

    def use(pattern: dict[int, int], times: int, least: int = 0) -> None:
        n = min(times, *[int(left[x] // k) for x, k in pattern.items()])
        if n > 0 and n * sum(pattern.values()) > least:
            out.append((pattern, n))
            for x, k in pattern.items():
                left[x] -= k * n

    for pattern, times, _ in exact:
        use(pattern, int(times + 1e-6))
    for pattern, times, total in solved:  # those that leave room, unless their pieces are few enough to be cut
        if (pattern, times, total) not in exact:
            use(pattern, int(times + 1e-6), FEW)
    for pattern, times, _ in sorted(exact, key=lambda s: -(s[1] % 1)):
        use(pattern, 1)
    more, aside = first_patterns(left, size, True)
    return out + [(p, int(n)) for p, n in more], {int(x): int(aside[x]) for x in np.flatnonzero(aside)}


class Places:
    """Where the piece of a length and rank (from 0) goes."""

    def __init__(self, histogram: dict[int, int], size: int = SIZE):
        used, rest = rounded(histogram, size)
        runs, base, taken = [], 0, dict.fromkeys(histogram, 0)
        for pattern, n in used:
            offset = 0
            for x in sorted(pattern, reverse=True):
                k = pattern[x]
                runs.append((x << 48 | taken[x], base, k, offset))
                taken[x] += n * k
                offset += x * k
            base += n
        self.keys, self.base, self.copies, self.offset = np.array(sorted(runs) or np.empty((0, 4)), np.int64).T
        #: first sequence, offset and length of every part of the pieces that are cut, by length and rank
        self.cuts: dict[int, list[tuple[int, int, int]]] = {}
        total = sum(x * n for x, n in rest.items())
        rooms = [size] * (total // size) + [1 << b for b in reversed(range(size.bit_length())) if total % size >> b & 1]
        at, filled = 0, 0
        for x in sorted(rest, reverse=True):
            for i in range(rest[x]):
                parts, todo = [], x
                while todo:
                    n = min(todo, rooms[at] - filled)
                    parts.append((base + at, filled, n))
                    todo, filled = todo - n, filled + n
                    if filled == rooms[at]:
                        at, filled = at + 1, 0
                self.cuts[x << 48 | taken[x] + i] = parts
        self.cut_keys = np.array(sorted(self.cuts), np.int64)
        self.n_sequences = base + len(rooms)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """sequence_id, offset of whole pieces, and the key in cuts of the others (-1 for whole ones)."""
        key = length << 48 | rank
        cut = np.where(np.isin(key, self.cut_keys), key, -1)
        at = np.maximum(np.searchsorted(self.keys, key, "right") - 1, 0)
        if not len(self.keys):
            return np.zeros_like(key), np.zeros_like(key), cut
        gone = rank - (self.keys[at] & (1 << 48) - 1)
        return self.base[at] + gone // self.copies[at], self.offset[at] + gone % self.copies[at] * length, cut


# ---------------------------------------------------------------- tasks

_ENCODERS: dict[str, Callable[[str], Iterator[bytes]]] = {}


def _ids(path: str, text: bytes, end_id: int) -> bytes:
    if path not in _ENCODERS:
        _ENCODERS[path] = byte_encoder(path)
    return b"".join(_ENCODERS[path](text.decode())) + end_id.to_bytes(4, "little")


def _cut(path: str, end_id: int, size: int):
    names = ["doc_id", "digest", "doc_tokens", "start", "length", "ids_crc32"]

    def run(batches):
        for batch in batches:
            at, rows = [], ([], [], [], [])
            for i, text in enumerate(texts(batch, "text")):
                ids = _ids(path, text, end_id)
                n = len(ids) // 4
                for a in range(0, n, size):
                    at.append(i)
                    part = ids[4 * a : 4 * (a + size)]
                    for x, y in zip(rows, (n, a, len(part) // 4, zlib.crc32(part)), strict=True):
                        x.append(y)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("digest").take(at), *[pa.array(x, pa.int64()) for x in rows]], names=names)

    return released(run)


def _place(places: Places):
    names = ["doc_id", "digest", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy()  # noqa: B023,E731
            sequence, offset, cut = places.find(get("length"), get("rank") - 1)
            at, start, length, crc = np.arange(len(cut)), get("start"), get("length"), get("ids_crc32")
            whole = np.zeros(len(cut), bool)
            extra = []
            for i in np.flatnonzero(cut >= 0):
                parts, gone = places.cuts[int(cut[i])], 0
                for seq, off, n in parts:
                    extra.append((i, start[i] + gone, n, crc[i], seq, off, len(parts) > 1))
                    gone += n
            keep = cut < 0
            cols = [at[keep], start[keep], length[keep], crc[keep], sequence[keep], offset[keep], whole[keep]]
            if extra:
                cols = [np.concatenate([c, np.array(e, c.dtype)]) for c, e in zip(cols, zip(*extra, strict=True), strict=True)]
            at, start, length, crc, sequence, offset, missing = cols
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("digest").take(rows), pa.array(start), pa.array(length), pa.array(crc, mask=missing), batch.column("doc_tokens").take(rows), pa.array(sequence), pa.array(offset)], names=names)

    return run


def _again(path: str, end_id: int):
    def run(batches):
        for batch in batches:
            out = [], [], [], [], []
            for i, (text, spans) in enumerate(zip(texts(batch, "text"), batch.column("spans").to_pylist(), strict=True)):
                ids = _ids(path, text, end_id)
                for s in spans:
                    for x, y in zip(out, (i, s["start"], s["length"], zlib.crc32(ids[4 * s["start"] : 4 * (s["start"] + s["length"])])), strict=False):
                        x.append(y)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("digest").take(at), *[pa.array(x, pa.int64()) for x in out[1:4]]], names=["doc_id", "digest", "start", "length", "crc"])

    return released(run)


def pack(docs: DataFrame, path: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of documents (doc_id, text).

    size is a power of two. A null text is empty and is one piece, the end id.
    Rows are documents whatever their ids: null and repeated ids, and repeated
    rows, are packed one by one. An empty table gives no rows; a very long text
    is encoded by stretches; other columns are ignored. Only lengths and counts
    come to the driver, and what is cut there is at most what one round of all
    patterns holds.
    """
    if size & (size - 1):
        raise ValueError("size is a power of two")
    ws = Workspace(docs.sparkSession, "packing")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("digest"))
    pieces = ws.write(keyed.mapInArrow(_cut(path, end_id, size), schema_of("doc_id long, digest binary, doc_tokens long, start long, length long, ids_crc32 long")), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most size rows
    places = Places(histogram, size)
    order = ranked(ws, pieces, "length", ["doc_id", "digest", "start"], "ranks")
    out = "doc_id long, digest binary, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = ws.write(order.mapInArrow(_place(places), schema_of(out)), "placed")
    # the ids of pieces that were cut are counted again, from the texts of their documents alone
    cut = placed.filter("ids_crc32 is null")
    same = lambda a, b, keys: [a[k].eqNullSafe(b[k]) for k in keys]
    spans = ws.write(cut.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "length")).alias("spans")), "spans")
    few = F.broadcast(spans)
    found = keyed.join(few, same(keyed, few, ["doc_id", "digest"])).select(keyed["doc_id"], keyed["digest"], "text", "spans").dropDuplicates(["doc_id", "digest"])
    crcs = ws.write(found.mapInArrow(_again(path, end_id), schema_of("doc_id long, digest binary, start long, length long, crc long")), "crcs")
    small = F.broadcast(crcs)
    mended = cut.join(small, same(cut, small, ["doc_id", "digest", "start", "length"])).select(cut["doc_id"], cut["start"], cut["length"], F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    return placed.filter("ids_crc32 is not null").drop("digest").unionByName(mended)
