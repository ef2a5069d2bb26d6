import hashlib
import random
import zlib

import numpy as np
import pytest

tokens = pytest.importorskip("public_tokenizers")
from sleuthgrid.llm.piece_spans import Normalizer, PieceEncoder, encode_pieces  # noqa: E402
from sleuthgrid.llm.common import Workspace  # noqa: E402
from sleuthgrid.llm.token_output import ShardReader, ShardWriter, from_planes, to_planes, read_shards, token_files, word_encoder, write_shards  # noqa: E402

TEXTS = [
    "", " ", "  two  spaces ", "a\nb\n\nc", "\n", "tab\tand\x0bvt \x0c", "It's we'll THEY'RE 'tis O'Neil", "naïve café ÀÉ é İstanbul ΣΑΣ σας",
    "▁under ▁▁ bars", "日本語 テスト 🙂🏽 𝔘nicode", "<|endoftext|> x<|startoftext|>y </s> <s> <unk> <0x41>", "\x00null\x00", "a" * 3000, "x y z　w", None,
    "trailing\n", "​zero ﻿bom", "don''t   ,,, ... !!!a1b22",
]


def test_planes_and_shards():
    rng = np.random.default_rng(0)
    for kind in ("bit", "byte"):
        for n in (1, 7, 8, 1000):
            ids = rng.integers(0, 2**32 if n == 7 else 50_000, n).astype("<u4")
            assert (from_planes(to_planes(ids, kind), n, kind) == ids).all()
        import io

        out = io.BytesIO()
        w = ShardWriter(out, 64, kind)
        docs = [rng.integers(0, 49_000, n).astype("<u4") for n in (0, 5, 300, 64, 0, 1, 128)]
        for i, d in enumerate(docs):
            w.add(i * 3 - 5, d)
        w.close()
        got = list(ShardReader(io.BytesIO(out.getvalue())).documents())
        assert [g[0] for g in got] == [i * 3 - 5 for i in range(7)]
        assert all((a == b[2]).all() and len(a) == len(b[2]) for a, b in zip(docs, got))
        assert [g[1] for g in got] == np.cumsum([0] + [len(d) for d in docs])[:-1].tolist()
        with pytest.raises(ValueError):
            ShardReader(io.BytesIO(out.getvalue()[:-1]))


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokens.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(8)
    some = ["".join(rng.choice("aBé'sTÀß½²_-.,!<|>\xa0\x85\x1c \n1") for _ in range(rng.randrange(30))) for _ in range(3000)]
    for x, ids in zip(some, word_encoder(path, 2)(some)):
        assert ids.tolist() == [*t.encode(x, add_special_tokens=False).ids, 2], repr(x)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in token_files(df, path).collect()}
    start = 0
    for i, x in enumerate(TEXTS):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), x
        start += len(ids)
    folder, manifest = write_shards(df, Workspace(spark, "small"), path, 2, block_size=8, shard_ids=50)
    small = {r.doc_id: r for r in read_shards(spark, folder, manifest).collect()}
    assert manifest.count() > 3 and small == got
    assert token_files(df.limit(0), path).count() == 0
    assert token_files(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string"), path).count() == 3


def test_pieces_as_the_library(spark):
    import sentencepiece as sp

    path = tokens.path("piece_bpe_32k.model")
    lib, own = sp.SentencePieceProcessor(model_file=path), PieceEncoder(path)
    assert own.by_word
    rng = random.Random(2)
    alphabet = "aeth  \n▁é日🙂\t.,'0"
    for x in [*TEXTS, *["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]]:
        x = x or ""
        ids, _ = own.encode(x)
        assert ids.tolist() == [*lib.encode(x), 2], repr(x)
        spans = own.spans(x, ids)
        assert "".join(x.encode()[a:b].decode("latin1") for a, b in spans).encode("latin1") == x.encode()
    df = spark.createDataFrame([(i, x, 5) for i, x in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    for r in encode_pieces(df, path, full=True).collect():
        ids = [*lib.encode(TEXTS[r.doc_id] or ""), 2]
        assert r.ids == ids and r.n_tokens == len(ids) and r.span_bytes == r.n_bytes
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_character_map_as_the_library():
    import sentencepiece as sp

    if not hasattr(sp, "SentencePieceNormalizer"):
        pytest.skip("no compiled map here")
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib = sp.SentencePieceNormalizer(rule_name="nmt_nfkc")
    model = pb.ModelProto()
    model.ParseFromString(lib.serialized_model_proto())
    spec = model.normalizer_spec
    own = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
    for x in ["ﬁne ½ ①", "  Ａｂｃ　　ｄ  ", "ｶﾞ が é", "plain", "​", "㌔ ㍿ x\ty\r\n", "  "]:
        norm, places = own.normalize(x.encode())
        assert norm.decode() == lib.normalize(x), repr(x)
        assert len(places) == len(norm) + 1 and (np.diff(places) >= 0).all()


def test_words_by_ranks_as_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    from sleuthgrid.llm import token_output

    path = tokens.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        says = json.load(f)
    vocab = says["model"]["vocab"]
    assert token_output._ranks(says, token_output._byte_letters(), "</w>") is not None
    # a file whose ids aren't in the order of its merges goes through the library's merges
    a, b = ("".join(m.split(" ") if isinstance(m, str) else m) for m in says["model"]["merges"][7:9])
    vocab[a], vocab[b] = vocab[b], vocab[a]
    other = tmp_path / "other.json"
    other.write_text(json.dumps(says))
    assert token_output._ranks(says, token_output._byte_letters(), "</w>") is None
    rng = random.Random(6)
    some = [x.removesuffix("</w>") for x in rng.sample(sorted(vocab), 8000) if x.isascii()]
    some += ["".join(rng.choice(some) for _ in range(rng.randrange(1, 6))) for _ in range(4000)]
    some += ["".join(rng.choice("eéßñŁłÀÿɏȺaQz½²³ºª_-'.,;:()\x00\x7f$€") for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    some += ["aaaa" * n for n in range(1, 30)] + ["the" * 333 + "a", "the" * 334, "thing" * 20_000, "é" * 999, "", "\n"]
    for file in (path, str(other)):
        lib = Tokenizer.from_file(file)
        for x, ids in zip(some, word_encoder(file, 2)(some), strict=True):
            assert ids.tolist() == [*lib.encode(x, add_special_tokens=False).ids, 2], repr(x[:80])
