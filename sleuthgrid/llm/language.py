"""Language by unigrams of pieces, summed over all segmentations.

Each language gives every piece of a public vocabulary a probability. A word's
likelihood is the sum, over all ways to cut it into pieces, of the product of
their probabilities: the forward algorithm adds it up in one pass, for sorted
words once for each beginning that they share, with an automaton that names
the pieces that end at a character. The
probabilities are learned by expectation-maximisation over the same cuts. A
character outside the vocabulary is a piece of its own with a small fixed
probability. Sums are kept in range by a factor for each character, which the
logarithm takes out again.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, released, schema_of, texts

LETTERS = re.compile(r"[^\W\d_]+")
SPACE = "▁"
#: Bound of what is learned from, texts of each language, and rounds of learning.
MOST_TEXTS, ROUNDS = 1500, 3
RARE = 1e-9
LONGEST = 40
#: A piece's probability is multiplied by this for each of its characters: (1e-10 * FACTOR)**LONGEST and FACTOR**LONGEST are both in range.
FACTOR = 1e3


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case. Fractions, raised and Roman numbers and the like, which a word pattern takes for letters, aren't."""
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return " ".join([w if w.isalpha() else "".join([c if c.isalpha() else " " for c in w]) for w in found]).split()


def vocabulary(model_path: str) -> dict[str, int]:
    """Pieces of letters in lower case, with a number for each."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    found = dict.fromkeys(p.piece.lower() for p in model.pieces if p.type == 1 and LETTERS.fullmatch(p.piece.lstrip(SPACE) or "a"))
    return {p: i for i, p in enumerate(found)}


def parts_of(word: str) -> list[str]:
    """A word with its mark of a start, in parts of at most LONGEST characters, so that sums can't underflow."""
    marked = SPACE + word
    return [marked[i : i + LONGEST] for i in range(0, len(marked), LONGEST)]


def _by_length(words: list[str]) -> dict[int, list[tuple[int, str]]]:
    """Parts of words, with the word's number, by length."""
    out: dict[int, list[tuple[int, str]]] = {}
    for at, w in enumerate(words):
        for part in parts_of(w):
            out.setdefault(len(part), []).append((at, part))
    return out


class Vocabulary:
    def __init__(self, pieces: dict[str, int]):
        self.pieces = pieces
        #: every piece and every start of one; a start that isn't a piece has no number
        self.starts: dict[str, int | None] = {p[:i]: None for p in pieces for i in range(1, len(p))} | pieces
        #: FACTOR for each character of a piece; the last is for a character that is none
        self.factors = FACTOR ** np.array([*[len(p) for p in pieces], 1.0])
        #: states of the automaton: after some characters, the longest end of them that is a start
        self.names = ["", *self.starts]
        self.states = {s: i for i, s in enumerate(self.names)}
        ends = [self._ends(s) for s in self.names]
        #: how many pieces end at a state's last character, where they begin in length and piece, and these
        self.n_ends = np.array([len(x) for x in ends])
        self.at_ends = np.cumsum(self.n_ends) - self.n_ends
        self.length, self.piece = np.array([y for x in ends for y in x], np.int32).T

    def _ends(self, s: str) -> list[tuple[int, int]]:
        """Length and number of all pieces that end s; a last character that isn't a piece is number -1."""
        found = [(len(s) - i, self.pieces[s[i:]]) for i in range(len(s)) if s[i:] in self.pieces]
        return found if found and found[-1][0] == 1 else [*found, (1, -1)]

    def follow(self, state: int, character: str) -> int:
        s = self.names[state] + character
        while s not in self.states:
            s = s[1:]
        return self.states[s]

    def lattice(self, parts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces inside parts of n characters: place (start * (n + 1) + end) in order, row, number (-1 for a character that isn't a piece)."""
        find, width = self.starts.get, n + 1
        place, row, piece = [], [], []
        for r, part in enumerate(parts):
            for i in range(n):
                alone = True
                for j in range(i + 1, width):
                    k = find(part[i:j], -1)
                    if k == -1:
                        break
                    if k is not None:
                        alone &= j > i + 1
                        place.append(i * width + j)
                        row.append(r)
                        piece.append(k)
                if alone:
                    place.append(i * width + i + 1)
                    row.append(r)
                    piece.append(-1)
        place, row, piece = (np.array(x, np.int32) for x in (place, row, piece))
        order = np.argsort(place, kind="stable")
        return place[order], row[order], piece[order]


def forward(lattice, rows: int, n: int, table: np.ndarray) -> np.ndarray:
    """Sums over all ways to reach each character: [character, row, language]."""
    place, row, piece = lattice
    ahead = np.zeros((n + 1, rows, table.shape[1]))
    ahead[0] = 1.0
    bounds = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        i, j = divmod(int(place[lo]), n + 1)
        ahead[j, row[lo:hi]] += ahead[i, row[lo:hi]] * table[piece[lo:hi]]
    return ahead


class _Steps(dict):
    """State after a state and a character (state * 0x110000 + code point), found when first asked for."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab

    def __missing__(self, key: int) -> int:
        self[key] = self.vocab.follow(key // 0x110000, chr(key % 0x110000))
        return self[key]


def ends_of(parts: list[str], vocab: Vocabulary, steps: _Steps, table: np.ndarray) -> np.ndarray:
    """Sums over all ways to cut each of some sorted parts: [part, language]. Beginnings that neighbours share are summed once."""
    sizes = np.array([len(p) for p in parts])
    rows, n = len(parts), int(sizes.max())
    codes = np.array(parts, f"<U{n}").view("<u4").reshape(rows, n)
    fresh = np.ones((rows, n), bool)
    fresh[1:] = ~np.logical_and.accumulate(codes[1:] == codes[:-1], axis=1)
    fresh &= np.arange(n) < sizes[:, None]
    # the beginnings of each length are numbered in order, after those of lengths before it; the first is the empty one
    count = np.array([1, *fresh.sum(axis=0).tolist()])
    base = np.cumsum(count) - count
    number = np.zeros((rows, n + 1), np.int64)
    number[:, 1:] = np.cumsum(fresh, axis=0) - 1 + base[1:]
    ahead, state = np.empty((int(count.sum()), table.shape[1])), np.zeros(int(count.sum()), np.int64)
    ahead[0] = 1.0
    for d in range(n):
        row = np.flatnonzero(fresh[:, d])
        keys = state[number[row, d]] * 0x110000 + codes[row, d]
        now = np.array(list(map(steps.__getitem__, keys.tolist())), np.int64)
        many = vocab.n_ends[now]
        first = np.cumsum(many) - many
        flat = np.arange(int(many.sum())) + np.repeat(vocab.at_ends[now] - first, many)
        before = number[np.repeat(row, many), d + 1 - vocab.length[flat]]
        own = slice(base[d + 1], base[d + 1] + len(row))
        state[own] = now
        ahead[own] = np.add.reduceat(ahead[before] * table[vocab.piece[flat]], first, axis=0)
    return ahead[number[np.arange(rows), sizes]]


class LanguageModel:
    def __init__(self, vocab: Vocabulary, languages: list[str], table: np.ndarray, prior: np.ndarray):
        self.vocab, self.languages, self.table, self.prior = vocab, languages, table, prior
        self.scaled = table * vocab.factors[:, None]
        self.steps = _Steps(vocab)

    def __reduce__(self):
        return LanguageModel, (self.vocab, self.languages, self.table, self.prior)

    def word(self, word: str) -> list[float]:
        """Log-likelihood of a word in each language."""
        return self.words([word])[0].tolist()

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language: the forward sum, over the sorted parts of all words."""
        own = [(part, at) for at, w in enumerate(words) for part in parts_of(w)]
        own.sort()
        total = np.zeros((len(words), len(self.languages)))
        step = max(1, 8_000_000 // ((LONGEST + 1) * max(1, len(self.languages))))
        for first in range(0, len(own), step):
            parts, at = zip(*own[first : first + step], strict=True)
            found = np.log(ends_of(parts, self.vocab, self.steps, self.scaled))
            np.add.at(total, list(at), found - np.array([[len(p)] for p in parts]) * math.log(FACTOR))
        return total


def learn(words: dict[str, dict[str, int]], vocab: Vocabulary, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """languages and a table [piece, language] of probabilities, by rounds of expectation-maximisation; its last row is for characters outside the vocabulary."""
    languages, size = sorted(words), len(vocab.pieces)
    seen = np.zeros((size + 1, len(languages)))
    for number, lang in enumerate(languages):
        names, counts = list(words[lang]), np.array(list(words[lang].values()), float)
        groups = []
        for n, group in _by_length(names).items():
            for first in range(0, len(group), 20_000):
                some = group[first : first + 20_000]
                groups.append((n, len(some), counts[[at for at, _ in some]], vocab.lattice([part for _, part in some], n)))
        p = np.append(np.full(size, 1.0 / max(1, size)), RARE)
        own = np.zeros(size + 1)
        for _ in range(rounds):
            own, scaled = np.zeros(size + 1), (p * vocab.factors)[:, None]
            for n, rows, times, (place, row, piece) in groups:
                ahead, back = forward((place, row, piece), rows, n, scaled)[:, :, 0], np.zeros((n + 1, rows))
                back[n] = 1.0
                i, j = np.divmod(place, n + 1)
                bounds = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
                for lo, hi in zip(bounds[-2::-1], bounds[:0:-1], strict=True):
                    back[i[lo], row[lo:hi]] += scaled[piece[lo:hi], 0] * back[j[lo], row[lo:hi]]
                share = ahead[i, row] * scaled[piece, 0] * back[j, row] * (times / ahead[n])[row]
                own += np.bincount(piece % (size + 1), share, size + 1)
            total = own.sum() + 1.0
            p = np.append((own[:-1] + 1.0 / len(own)) / total, RARE)
        seen[:, number] = own
    seen[-1] = 0
    # what a language hasn't shown is shared out as in all languages together
    pooled = seen.sum(axis=1, keepdims=True)
    pooled = (pooled + 0.1) / (pooled.sum() + 0.1 * len(pooled))
    strength = np.maximum(50.0, 0.01 * seen.sum(axis=0))
    table = (seen + strength * pooled) / (seen.sum(axis=0) + strength)
    table[-1] = RARE
    return languages, table


def _count(batches):
    for batch in batches:
        lang = batch.column("lang").to_pylist()
        out: dict[tuple[str, str], int] = {}
        for i, text in enumerate(texts(batch, "text")):
            for w in words_of(text.decode()):
                out[lang[i], w] = out.get((lang[i], w), 0) + 1
        if out:
            yield pa.record_batch([pa.array([k[0] for k in out]), pa.array([k[1] for k in out]), pa.array(list(out.values()), pa.int64())], names=["lang", "word", "n"])


def fit(docs: DataFrame, model_path: str, held_out: int = 1) -> LanguageModel:
    """Learn from text and non-null lang of documents whose crc32(doc_id) mod 3 is not held_out.

    At most MOST_TEXTS texts of each language are used, in the order of a hash
    of doc_id, with all of their words. Priors are the shares of all training
    rows. Without training rows every text with a letter gets
    ``und``.
    """
    ws = Workspace(docs.sparkSession, "language")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter((F.crc32(F.col("doc_id").cast("string")) % 3 != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    vocab = Vocabulary(vocabulary(model_path))
    if not sizes:
        return LanguageModel(vocab, [], np.full((len(vocab.pieces) + 1, 0), RARE), np.zeros(0))
    # rows are chosen by a share of the hash's range, a little wider than needed, before the exact cut
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = F.lit(None)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * MOST_TEXTS / n + 50 / n))).otherwise(share)
    near = rows.filter(unit <= share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = near.withColumn("r", rank).filter(F.col("r") <= MOST_TEXTS).select("lang", "text")
    counts = picked.mapInArrow(_count, schema_of("lang string, word string, n long")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words: dict[str, dict[str, int]] = {k: {} for k in sizes}
    for r in ws.write(counts, "words").sort("lang", "word").collect():  # the words of at most MOST_TEXTS texts of each language
        words[r.lang][r.word] = r.n
    languages, table = learn(words, vocab)
    ws.drop("words")
    prior = np.log(np.array([sizes[x] + 1.0 for x in languages]) / sum(sizes.values()))
    return LanguageModel(vocab, languages, table, prior)


def _predict(model: LanguageModel, most: int = 1_000_000, run_length: int = 200_000):
    """Runs between white space are numbered as they come; new ones are scored together, after texts of run_length runs.

    No word crosses white space, and no letter's lower case depends on what is
    behind it. The memory of runs and words is emptied when it holds more than
    most of them, or 32 characters for each.
    """

    def run(batches):
        runs: dict[str, int] = {}
        words: dict[str, int] = {}
        size = 0
        # of each run, how many words it has and their sum in each language; of each word, its likelihoods
        run_table, word_table = np.zeros((1024, 1 + len(model.languages))), np.zeros((1024, len(model.languages)))

        def learn(new: list[str]) -> int:
            nonlocal run_table, word_table
            found = [words_of(x) for x in new]
            fresh = list({w for x in found for w in x}.difference(words))
            at = len(words)
            words.update(zip(fresh, range(at, at + len(fresh)), strict=True))
            word_table = _longer(word_table, len(words))
            if fresh:
                word_table[at : len(words)] = model.words(fresh)
            at = len(runs)
            runs.update(zip(new, range(at, at + len(new)), strict=True))
            run_table = _longer(run_table, len(runs))
            n = np.array([len(x) for x in found])
            own = np.zeros((len(new), run_table.shape[1]))
            own[:, 0] = n
            have = np.flatnonzero(n)
            if len(have):
                own[have, 1:] = np.add.reduceat(word_table[[words[w] for x in found for w in x]], (np.cumsum(n) - n)[have], axis=0)
            run_table[at : len(runs)] = own
            return sum(map(len, new)) + sum(map(len, fresh))

        for batch in batches:
            pred, score = ["und"] * len(batch), [0.0] * len(batch)
            waiting: list[tuple[int, list[str]]] = []
            n_waiting = 0
            for at, text in enumerate(texts(batch, "text")):
                own = text.decode().split() if model.languages else []
                if own:
                    waiting.append((at, own))
                    n_waiting += len(own)
                if n_waiting < run_length and at < len(batch) - 1:
                    continue
                new = list(set().union(*[x for _, x in waiting]).difference(runs))
                if new:
                    size += learn(new)
                for i, own in waiting:
                    total = run_table[np.array(list(map(runs.__getitem__, own)), np.int64)].sum(axis=0)
                    if not total[0]:
                        continue
                    total = model.prior + total[1:]
                    total = np.exp(total - total.max())
                    total /= total.sum()
                    best = int(total.argmax())
                    pred[i], score[i] = model.languages[best], float(total[best])
                waiting, n_waiting = [], 0
                if len(runs) + len(words) > most or size > 32 * most:
                    runs.clear()
                    words.clear()
                    size = 0
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*[batch.column(c) for c in names], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return released(run)


def _longer(table: np.ndarray, n: int) -> np.ndarray:
    """table with at least n rows, at least doubled where it is too short."""
    return table if n <= len(table) else np.concatenate([table, np.zeros((max(len(table), n - len(table)), table.shape[1]))])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (posterior of the predicted language).

    A text that is null or has no letter gets ``und`` and 0; however long, a text
    is scored whole, and so is a word, in parts of LONGEST characters. A null
    doc_id isn't held out. Rows repeat in the result as in the table; other columns are
    ignored; an empty table gives no rows.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    out = base.mapInArrow(_predict(model), schema_of(f"doc_id {kind}, lang_pred string, score double"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
