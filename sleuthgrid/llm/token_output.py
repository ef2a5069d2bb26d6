"""Token ids in bit-plane files.

A file (shard) is, in order: 8 bytes of magic; blocks of block_size ids, the
last one shorter, of which each is turned into planes (bit j, or byte j, of
every id in turn) and each plane is compressed by zstandard on its own; the
table of documents (ids and lengths, compressed); the chunk index (offset and
length of every plane, compressed; a length of 0 is a plane of zeros); and a
fixed-size footer that says where these are. Any block can be read alone.

Shards follow the order of doc_id: the documents are dealt into ranges, and
each task writes one shard, block by block, under a name that it gives up only
when the file is whole. A task that runs again writes the same bytes again.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions, schema_of, texts

MAGIC = b"BPLANE01"
FOOTER = "<8sQQQQQ"
FOOTER_SIZE = struct.calcsize(FOOTER)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """32 bit planes or 4 byte planes of unsigned 32-bit ids; an empty bytes object is a plane of zeros."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = raw.T
    else:
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    width = n if kind == "byte" else (n + 7) // 8
    rows = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(width, np.uint8) for p in planes])
    if kind == "byte":
        raw = np.ascontiguousarray(rows.T)
    else:
        raw = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class ShardWriter:
    """Writes ids and documents to a binary stream with bounded memory."""

    def __init__(self, out, block_size: int = 1 << 16, kind: str = "bit", level: int = 3):
        if kind not in ("bit", "byte"):
            raise ValueError("kind is bit or byte")
        self.out, self.size, self.kind = out, block_size, kind
        self.zip = zstandard.ZstdCompressor(level=level)
        self.wait: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.index: list[tuple[int, int]] = []
        self.at = out.write(MAGIC) and len(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        for plane in to_planes(ids, self.kind):
            data = self.zip.compress(plane) if plane else b""
            self.index.append((self.at, len(data)))
            self.out.write(data)
            self.at += len(data)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.size:
            joined = np.concatenate(self.wait)
            whole = len(joined) // self.size * self.size
            for i in range(0, whole, self.size):
                self._block(joined[i : i + self.size])
            self.wait, self.waiting = [joined[whole:].copy()], len(joined) - whole

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.wait))
        table = self.zip.compress(np.array([self.docs, self.lengths], "<i8").tobytes())
        index = self.zip.compress(np.array(self.index, "<u8").tobytes())
        head = json.dumps({"block_size": self.size, "kind": self.kind}).encode()
        for part in (table, index, head):
            self.out.write(part)
        self.out.write(struct.pack(FOOTER, MAGIC, self.n_ids, self.at, self.at + len(table), self.at + len(table) + len(index), len(self.docs)))


class ShardReader:
    """Reads a shard from a seekable binary file: its footer and index first, then block by block."""

    def __init__(self, file):
        size = file.seek(0, 2)
        self.file, self.zip = file, zstandard.ZstdDecompressor()
        if size < FOOTER_SIZE + len(MAGIC):
            raise ValueError("not a whole bit-plane file")
        magic, self.n_ids, table, index, head, n_docs = struct.unpack(FOOTER, self._range(size - FOOTER_SIZE, FOOTER_SIZE))
        if magic != MAGIC or self._range(0, 8) != MAGIC:
            raise ValueError("not a whole bit-plane file")
        says = json.loads(self._range(head, size - FOOTER_SIZE - head))
        self.size, self.kind = says["block_size"], says["kind"]
        self.doc_ids, self.lengths = np.frombuffer(self.zip.decompress(self._range(table, index - table)), "<i8").reshape(2, n_docs)
        self.index = np.frombuffer(self.zip.decompress(self._range(index, head - index)), "<u8").reshape(-1, 32 if self.kind == "bit" else 4, 2)

    def _range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        """The ids of block k, by one read of the range that its planes take."""
        n, rows = min(self.size, self.n_ids - k * self.size), self.index[k].astype(np.int64)
        first = int(rows[0, 0])
        data = self._range(first, int(rows[-1].sum()) - first)
        return from_planes([self.zip.decompress(data[a - first : a - first + b]) if b else b"" for a, b in rows.tolist()], n, self.kind)

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """doc_id, first id's place in the file, ids."""
        held, first, k, at = np.empty(0, "<u4"), 0, 0, 0
        for doc_id, n in zip(self.doc_ids.tolist(), self.lengths.tolist(), strict=True):
            parts = [held[at - first : at - first + n]]
            while first + len(held) < at + n:
                first += len(held)
                held = self.block(k)
                k += 1
                parts.append(held[max(0, at - first) : at + n - first])
            yield doc_id, at, np.concatenate(parts) if len(parts) > 1 else parts[0]
            at += n


#: White space to str.split() but not to the tokenizer file.
CONTROL = "\x1c\x1d\x1e\x1f"


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: its own if that is printed, else one of those from 256 on; a space stays."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(others)} | {0x20: 0x20}


def _symbol(byte: int, final: bool) -> str:
    """A character for a byte of a piece, another one for its last byte: small letters stay and end a piece as capitals, as pieces have none."""
    if 0x61 <= byte <= 0x7A:
        return chr(byte - 0x20 if final else byte)
    return chr((0x200 if final else 0x100) + byte)


def _ranks(says: dict, letters: dict[int, int], suffix: str):
    """The file's merges by ranks of symbols, or None if it isn't of the kind: bytes, bytes that end a word, then the merges in their order."""
    import tiktoken

    vocab, special = says["model"]["vocab"], {t["content"] for t in says["added_tokens"]}
    back = {chr(letter): byte for byte, letter in letters.items() if byte != 0x20} | {chr(256 + 0x20): 0x20}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in says["model"]["merges"]]
    own = {t: i for t, i in vocab.items() if t not in special}
    single = {c + end for c in back for end in ("", suffix)}
    if len(own) != 512 + len(merged) or any(own.get(m) != 512 + i for i, m in enumerate(merged)) or single != {t for t, i in own.items() if i < 512}:
        return None
    if says["model"].get("unk_token") or says["model"].get("dropout") or says["model"].get("ignore_merges") or says["model"].get("continuing_subword_prefix"):
        return None
    ranks = {}
    for t, i in own.items():
        text = t.removesuffix(suffix)
        cut = len(text) - (text != t)
        ranks["".join([_symbol(back[c], k >= cut) for k, c in enumerate(text)]).encode()] = i
    # a byte alone is no symbol if it begins or goes on with one; it only needs a number
    ranks |= {bytes([b]): len(vocab) + b for b in range(256) if bytes([b]) not in ranks}
    return tiktoken.Encoding("symbols", pat_str=r"[^\n]+", mergeable_ranks=ranks, special_tokens={})


def word_encoder(path: str, end_id: int, most: int = 1_000_000) -> Callable[[list[str]], Iterator[np.ndarray]]:
    """Encodes texts with a tokenizers file whose tokens never cross white space: each run between is encoded once.

    New runs of Latin letters, which normalisation only turns into lower case,
    are cut all at once as the file's own pattern cuts them, and their different
    pieces go through the file's merges many at a time, told apart by the mark
    of a word's end; all other runs, and those of over 1,000 characters, go
    through the whole file one by one. Merges are done by ranks (the ids, if
    the file lists its merges in their order), else by the library. The
    memory of runs is emptied when it holds more than most.
    """
    import os
    import re

    import regex

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # fixed value: the pattern of the tokenizer file
    own = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    pattern = regex.compile(own + r"|\n")
    with open(path, encoding="utf-8") as f:
        says = json.load(f)
    steps = [x["type"] for x in (says["normalizer"] or {}).get("normalizers", [])]
    before = (says["pre_tokenizer"] or {}).get("pretokenizers", [])
    suffix = says["model"].get("end_of_word_suffix")
    cut = bool(suffix) and steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in before] == ["Split", "ByteLevel"] and before[0]["pattern"] == {"Regex": own} and not before[1]["use_regex"] and not before[1]["add_prefix_space"]
    merges = Tokenizer.from_str(json.dumps(says | {"normalizer": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}, "added_tokens": []}))
    letters = _byte_letters()
    fast = _ranks(says, letters, suffix) if cut else None
    inner, final = ({b: _symbol(b, is_final) for b in range(256)} for is_final in (False, True))
    ends = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    if suffix:
        ends[[k for t, k in tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
    rare_letter = re.compile("[\x1c-\x1f\x85\u0130\u0250-\U0010ffff]")
    known: dict[str, bytes] = {}
    white = str.maketrans({c: " " for c in "\t\n\r\x0b\x0c"})
    end = struct.pack("<I", end_id)

    def alone(new: list[str]) -> None:
        for run, enc in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[run] = np.array(enc.ids, "<u4").tobytes()

    def odd(run: str) -> bool:
        return "<|" in run or rare_letter.search(run) is not None

    def merged(pieces: list[str], step: int = 3000) -> np.ndarray:
        """The ids of all pieces."""
        if fast is not None:
            coded = [p.encode().decode("latin-1") for p in pieces]
            ends_ = "".join([c[-1] for c in coded]).translate(final)
            # no symbol is a line break, so what is between two is a piece
            starts_ = "\n".join([c[:-1] for c in coded]).translate(inner | {0x0A: "\n"}).split("\n")
            return np.array(fast.encode_ordinary("\n".join(map(str.__add__, starts_, ends_))), "<u4")
        groups = [pieces[i : i + step] for i in range(0, len(pieces), step)]
        coded = merges.encode_batch_fast([" ".join(g).encode().decode("latin-1").translate(letters) for g in groups], add_special_tokens=False)
        return np.concatenate([np.array(c.ids, "<u4") for c in coded]) if coded else np.empty(0, "<u4")

    def together(new: list[str]) -> bool:
        """False if pieces and ids can't be matched."""
        found = pattern.findall("\n".join(new).lower())
        number = {piece: i for i, piece in enumerate(dict.fromkeys([*found, "\n"]))}
        pieces = [piece for piece in number if piece != "\n"]
        ids = merged(pieces)
        stop = np.flatnonzero(ends[ids]) + 1
        if len(stop) != len(pieces):
            return False
        stop = np.insert(stop, number["\n"], stop[number["\n"] - 1] if number["\n"] else 0)
        size = np.diff(np.append(0, stop))
        at = np.array([number[piece] for piece in found], np.int64)
        total = np.cumsum(size[at])
        flat = np.arange(total[-1] if len(total) else 0) - np.repeat(total - stop[at], size[at])
        data = ids[flat].tobytes()
        last = [*total[at == number["\n"]].tolist(), len(flat)]
        known.update((run, data[4 * a : 4 * b]) for run, a, b in zip(new, [0, *last[:-1]], last, strict=True))
        return True

    def learn(new: list[str]) -> None:
        rare = [run for run in new if len(run) > 1000 or odd(run)] if not cut or max(map(len, new)) > 1000 or odd("\n".join(new)) else []
        plain = new if not rare else list(set(new).difference(rare))
        if not cut or plain and not together(plain):
            rare = new
        alone(rare)

    def encode(batch: list[str]) -> Iterator[np.ndarray]:
        done = 0
        while done < len(batch):
            # new runs of about a million characters are learned at once
            part, size = [], 0
            while done + len(part) < len(batch) and size < 1_000_000:
                text = batch[done + len(part)]
                part.append(text.translate(white).split(" ") if any(c in text for c in CONTROL) else text.split())
                size += len(text)
            if len(known) > most:
                known.clear()
            new = list(set().union(*part).difference(known))
            if new:
                learn(new)
            for runs in part:
                yield np.frombuffer(b"".join(map(known.__getitem__, runs)) + end, "<u4")
            done += len(part)

    return encode


#: The encoders of this worker, which serve its later tasks too.
_ENCODERS: dict[tuple[str, int], Callable[[list[str]], Iterator[np.ndarray]]] = {}


def _write(folder: str, path: str, end_id: int, block_size: int, kind: str, shard_ids: int):
    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        where, root = fs.FileSystem.from_uri(folder)
        if (path, end_id) not in _ENCODERS:
            _ENCODERS[path, end_id] = word_encoder(path, end_id)
        encode, number, writer, made = _ENCODERS[path, end_id], 0, None, []

        def finish() -> None:
            writer.close()
            out.close()
            where.move(temp, f"{root}/{name}")
            made.append((part, number, name, len(writer.docs), writer.n_ids))

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for doc_id, found in zip(ids, encode([t.decode() for t in texts(batch, "text")]), strict=True):
                if writer is None:
                    where.create_dir(root, recursive=True)
                    name = f"shard-{part:07d}-{number:05d}.bpl"
                    temp = f"{root}/_{name}.{uuid.uuid4().hex}"
                    out = where.open_output_stream(temp)
                    writer = ShardWriter(out, block_size, kind)
                writer.add(doc_id, found)
                if writer.n_ids >= shard_ids:
                    finish()
                    writer, number = None, number + 1
        if writer is not None:
            finish()
        if made:
            yield pa.record_batch([list(x) for x in zip(*made, strict=True)], names=["part", "number", "name", "n_docs", "n_ids"])

    return run


def write_shards(docs: DataFrame, ws: Workspace, tokenizer_path: str, end_id: int, block_size: int = 1 << 16, kind: str = "byte", shard_ids: int = 1 << 26) -> tuple[str, DataFrame]:
    """Encode docs (doc_id, text) and write them in ascending doc_id order: folder, manifest (part, number, name, n_docs, n_ids, start).

    A task begins a new shard once one holds shard_ids ids, so a shard's size
    doesn't grow with the range of a task.
    """
    folder = f"{ws.folder}/shards"
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = keyed.repartitionByRange(partitions(docs.sparkSession), "id").sortWithinPartitions("id", "text")
    made = ws.write(dealt.mapInArrow(_write(folder, tokenizer_path, end_id, block_size, kind, shard_ids), schema_of("part long, number long, name string, n_docs long, n_ids long")), "manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return folder, made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(folder: str, rows_at_once: int = 20_000):
    def run(batches):
        from pyarrow import fs

        names = ["id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                where, root = fs.FileSystem.from_uri(folder)
                rows = [], [], [], []
                with where.open_input_file(f"{root}/{name}") as file:
                    for doc_id, at, ids in ShardReader(file).documents():
                        for x, y in zip(rows, (doc_id, start + at, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                            x.append(y)
                        if len(rows[0]) >= rows_at_once:
                            yield pa.record_batch([pa.array(x, pa.int64()) for x in rows], names=names)
                            rows = [], [], [], []
                if rows[0]:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in rows], names=names)

    return run


def read_shards(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. Shards are dealt to tasks and read range by range."""
    dealt = manifest.select("name", "start").repartition(partitions(spark), "name")
    out = dealt.mapInArrow(_read(folder), schema_of("id long, start long, n_tokens long, ids_crc32 long"))
    return out.select(F.when(F.col("id") != F.lit(-(2**63)), F.col("id")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Encode, write, read back. A null text is empty and has the end id alone; a null doc_id comes first; rows that share a doc_id are ordered by text; an empty table gives no rows; other columns are ignored."""
    folder, manifest = write_shards(docs, Workspace(docs.sparkSession, "tokens"), tokenizer_path, end_id)
    return read_shards(docs.sparkSession, folder, manifest)
