import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from quillgraph.llm import sentencepiece_codec as C

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "   ", "a  b", " lead", "trail ", "<s> </s> <unk> <0x0A>", "line\nbreak\ttab", "▁mark▁", "日本語 🎉 ñ é", "x" * 5000, "\x00\x7f", "́combining"]


def texts():
    rng = random.Random(4)
    return HARD + ["".join(rng.choice("aeinrst  THEß漢é.,\n09") for _ in range(rng.randrange(200))) for _ in range(300)]


def test_bpe_model_parity_and_decoding():
    codec, own = C.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    packed, parity = codec.encode(texts())
    ids = [np.frombuffer(p, "<i4").tolist() for p in packed]
    assert ids == own.encode(texts()) and all(parity)
    for x in ids:
        assert codec.decode(np.array(x, np.int32)) == codec.tokenizer.decode(x, skip_special_tokens=False) == own.decode(x)
    broken = [codec.model.ids(C.BYTE)[0xFF], 400]
    assert codec.decode(np.array(broken)) == codec.tokenizer.decode(broken, skip_special_tokens=False)


def handmade(path, **normal):
    """A small unigram model written by hand: nothing is trained."""
    proto = pb.ModelProto()
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = 1, True
    proto.trainer_spec.unk_id, proto.trainer_spec.bos_id, proto.trainer_spec.eos_id, proto.trainer_spec.pad_id = 0, -1, -1, -1
    proto.normalizer_spec.name = "identity"
    for k, v in normal.items():
        setattr(proto.normalizer_spec, k, v)
    rows = [("<unk>", 0, 2)] + [(f"<0x{b:02X}>", -20, 6) for b in range(256)]
    rows += [(p, -s, 1) for p, s in (("▁", 2.5), ("a", 3), ("b", 3.5), ("ab", 4), ("▁ab", 4.25), ("ba", 5), ("▁a", 5.5), ("aba", 6))]
    for piece, score, kind in rows:
        proto.pieces.add(piece=piece, score=score, type=kind)
    path.write_bytes(proto.SerializeToString())
    return str(path)


@pytest.mark.parametrize("normal", [{"remove_extra_whitespaces": False}, {"remove_extra_whitespaces": True}, {"add_dummy_prefix": False, "remove_extra_whitespaces": False}])
def test_unigram_model_parity(tmp_path, normal):
    path = handmade(tmp_path / "u.model", **normal)
    own, codec = sentencepiece.SentencePieceProcessor(model_file=path), C.Codec(path)
    rng = random.Random(1)
    given = ["ab aba", " abab  ba ", "zé a"] + ["".join(rng.choice("ab z") for _ in range(rng.randrange(30))) for _ in range(200)]
    packed, parity = codec.encode(given)
    assert [np.frombuffer(p, "<i4").tolist() for p in packed] == own.encode(given) and all(parity)


def test_rows(spark):
    rows = [(1, None), (1, "a b"), (1, "a b"), (None, ""), (3, "long words " * 20000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    found = C.decode(C.encode(df, PATH), PATH).collect()
    assert sorted((r.doc_id or -1, r.decoded or "-", r.parity, r.round_trip) for r in found) == sorted((i or -1, t or "-", True, True) for i, t in rows)
    assert {r.n_tokens for r in found if not r.text} == {0}
    assert C.decode(C.encode(df.limit(0), PATH), PATH).count() == 0
