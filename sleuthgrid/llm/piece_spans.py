"""SentencePiece encoding with the original byte span of every piece, and decoding.

The normaliser works as the model says: at each place the longest prefix that
the compiled character map holds is replaced, else one character is kept, and
every byte of the normalised text remembers the byte of the source it came
from. Pieces are taken over the normalised text, so their lengths add up to
places in it, which are projected to the source.

If no piece of the vocabulary joins a word to the space after it, and none
holds a line feed, then no merge crosses such a place, so the library encodes
each stretch between two of them once. Otherwise whole texts are encoded.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, schema_of, texts

SPACE = "▁"
#: Kinds of piece in the model file (fixed values of its format).
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6


class CharacterMap:
    """The compiled map: a double-array trie of source sequences, and the texts that replace them."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix at a place, and its replacement."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._child(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= self._child(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.texts.index(b"\0", found[1])
        return found[0], self.texts[found[1] : end]

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Normalizer:
    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, remove_extra: bool = False, escape: bool = True):
        self.map, self.dummy, self.remove = CharacterMap(charsmap), dummy_prefix, remove_extra
        self.space = SPACE.encode() if escape else b" "

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the place in the source."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.remove:
            raw = np.frombuffer(data, np.uint8)
            wide = np.where(raw == 0x20, len(self.space), 1)
            lead = self.space if self.dummy else b""
            places = np.concatenate([np.zeros(len(lead), np.int64), np.repeat(np.arange(len(raw)), wide), [len(raw)]])
            return lead + data.replace(b" ", self.space), places
        parts: list[tuple[int, int, bytes]] = []
        at = 0
        while at < len(data):
            if (hit := self.map.longest(data, at)) is not None:
                n, text = hit
            else:
                n = 1
                while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                    n += 1
                text = data[at : at + n]
            parts.append((at, n, text))
            at += n
        if self.remove:
            parts = self._squeezed(parts)
        end = parts[-1][0] + parts[-1][1] if parts else len(data)
        if not parts:
            return b"", np.array([len(data)])
        out, places = bytearray(), []
        if self.dummy:
            out += self.space
            places += [parts[0][0]] * len(self.space)
        for start, _, text in parts:
            text = text.replace(b" ", self.space)
            out += text
            places += [start] * len(text)
        return bytes(out), np.array([*places, end])

    @staticmethod
    def _squeezed(parts: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
        """Without spaces at the ends, and with one space for each run of them."""
        out, after_space = [], True
        for start, n, text in parts:
            kept = bytearray()
            for b in text:
                if b != 0x20 or not after_space:
                    kept.append(b)
                after_space = b == 0x20
            if kept:
                out.append((start, n, bytes(kept)))
        while out and out[-1][2].endswith(b" "):
            start, n, text = out.pop()
            if text := text.rstrip(b" "):
                out.append((start, n, text))
        return out


class PieceEncoder:
    """Ids and byte spans of a text, as the library encodes it; and back."""

    def __init__(self, path: str, most: int = 300_000):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sp.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.normalizer = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.lengths = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in model.pieces], np.int32)
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == UNKNOWN}
        self.end = self.sp.eos_id()
        alone = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix and spec.escape_whitespaces
        crossing = re.compile(f"[^{SPACE}]{SPACE}|\n.|.\n", re.S)
        self.by_word = bool(alone and not model.trainer_spec.treat_whitespace_as_suffix and model.trainer_spec.byte_fallback and not any(p.type == USER_DEFINED or p.type == 1 and crossing.search(p.piece) for p in model.pieces))
        self.single = self.sp.piece_to_id(SPACE)
        self.names = [str(i) for i in range(len(model.pieces))]
        self.known: dict[str, tuple[bytes, str]] = {}
        self.most = most
        self.stretch = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")

    def _ids(self, part: str) -> list[int]:
        """Ids of a stretch of escaped text. The library puts a space before what it gets, so a stretch without one goes behind a line feed, whose ids are known."""
        if part == SPACE:
            return [self.single]
        if part[0] == SPACE:
            return self.sp.encode(part[1:].replace(SPACE, " "))
        return self.sp.encode("\n" + part)[len(self.sp.encode("\n")) :]

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids with the end id, and the same in decimal, joined by one space."""
        if not self.by_word:
            ids = [*self.sp.encode(text), self.end]
            return np.array(ids, "<i4"), " ".join(map(self.names.__getitem__, ids))
        parts = self.stretch.findall(SPACE + text.replace(" ", SPACE)) if text else []
        known = self.known
        new = [p for p in set(parts) if p not in known]
        if new:
            if len(known) > self.most:
                known.clear()
                new = list(set(parts))
            for p in new:
                ids = self._ids(p)
                known[p] = struct.pack(f"<{len(ids)}i", *ids), " ".join(map(self.names.__getitem__, ids))
        found = [known[p] for p in parts]
        joined = " ".join([*[s for _, s in found], self.names[self.end]])
        return np.frombuffer(b"".join([b for b, _ in found]) + struct.pack("<i", self.end), "<i4"), joined

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Start and end byte in the source of each id but the end id; where pieces and alignment don't fit each other, those of the library's surfaces."""
        data = text.encode()
        norm, places = self.normalizer.normalize(data)
        own = ids[:-1]
        lengths = self.lengths[own].copy()
        if self.unknown and np.isin(own, list(self.unknown)).any():
            lengths = np.array([len(p.piece.encode()) if p.id not in self.unknown else len(p.surface.encode()) for p in self.sp.encode(text, out_type="immutable_proto").pieces])
        edges = np.concatenate([[0], np.cumsum(lengths)])
        if edges[-1] != len(norm):
            ends = np.cumsum([len(p.surface.encode()) for p in self.sp.encode(text, out_type="immutable_proto").pieces], dtype=np.int64)
            return np.stack([np.append(0, ends[:-1]), ends], axis=1)
        return np.stack([places[edges[:-1]], places[edges[1:]]], axis=1) if len(own) else np.empty((0, 2), np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


def _rows(path: str, others: list[str], full: bool):
    def run(batches):
        encoder = PieceEncoder(path)
        for batch in batches:
            out = [[] for _ in range(6)]
            wide = [[], []]
            for data in texts(batch, "text"):
                text = data.decode()
                ids, names = encoder.encode(text)
                spans = encoder.spans(text, ids)
                decoded = encoder.decode(ids)
                covered = int((spans[:, 1] - spans[:, 0]).sum()) if len(spans) else 0
                for x, y in zip(out, (len(ids), hashlib.sha256(names.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), covered, len(data), hashlib.sha256(np.ascontiguousarray(spans, "<i8").tobytes()).hexdigest()), strict=True):
                    x.append(y)
                if full:
                    wide[0].append(ids.tolist())
                    wide[1].append(spans.reshape(-1).tolist())
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", "n_bytes", "spans_sha256"]
            arrays = [*[batch.column(c) for c in others], *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]]
            if full:
                arrays += [pa.array(wide[0], pa.list_(pa.int32())), pa.array(wide[1], pa.list_(pa.int64()))]
                names += ["ids", "spans"]
            yield pa.record_batch(arrays, names=[*others, *names])

    return released(run)


def encode_pieces(docs: DataFrame, model_path: str, full: bool = False) -> DataFrame:
    """Encode and decode every text: the columns of docs without text, then n_tokens, ids_sha256, decoded_sha256, span_bytes, n_bytes, spans_sha256 and, if full, ids and spans (start and end of each piece in turn).

    A null text is empty: the end id alone, no spans; a long text is encoded whole; rows repeat as they are. span_bytes equals n_bytes
    wherever the normaliser drops nothing. Columns that clash with added ones
    are replaced; an empty table gives no rows.
    """
    added = {"n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", "n_bytes", "spans_sha256", "ids", "spans", "text"}
    others = [c for c in docs.columns if c.lower() not in added]
    base = docs.select(*others, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.select(*others).schema.fields)
    tail = "n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long, n_bytes long, spans_sha256 string" + ", ids array<int>, spans array<long>" * full
    return base.mapInArrow(_rows(model_path, others, full), schema_of(fields + tail))
