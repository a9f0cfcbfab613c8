"""SentencePiece models with other normalisers and of the unigram kind, against the library."""

import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from driftlens.llm.queries_text import tokenizer_file
from driftlens.llm.sentencepiece import Transducer


def changed(**how):
    """The public model with another normaliser or kind; its pieces stay, so nothing is trained."""
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        m = pb.ModelProto.FromString(f.read())
    for k, v in how.items():
        if k == "rule":
            m.normalizer_spec.precompiled_charsmap = pb.NormalizerSpec.FromString(charsmap(v)).precompiled_charsmap
        elif k == "model_type":
            m.trainer_spec.model_type = v
            for i, p in enumerate(m.pieces):
                p.score = 0.0 if p.type != p.NORMAL else -1.0 - (i * 2654435761 % 9973) / 997
        elif k == "byte_fallback":
            m.trainer_spec.byte_fallback = v
            for p in m.pieces:
                if p.type == p.BYTE:
                    p.type = p.UNUSED
        elif k == "treat_whitespace_as_suffix":
            m.trainer_spec.treat_whitespace_as_suffix = v
        else:
            setattr(m.normalizer_spec, k, v)
    return m.SerializeToString()


def charsmap(rule):
    made = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    return pb.ModelProto.FromString(made.serialized_model_proto()).normalizer_spec.SerializeToString()


def samples():
    rnd = random.Random(9)
    alphabet = list("abcdeinrst  \n\t▁éñßАБ漢字🎉<>|{}0123456789.,'\"-_THEﬁ①ｱ℃Ⅳｶﾞ　 ́Å​½")
    return ["", " ", "   ", " a  b ", "ﬁn　x", "ｶﾞｷﾞ"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(600)] + ["x" * 90 + "the them" * 30]


KINDS = {
    "identity": {},
    "trimmed": {"remove_extra_whitespaces": True},
    "no prefix": {"add_dummy_prefix": False},
    "suffix": {"treat_whitespace_as_suffix": True},
    "nfkc": {"rule": "nfkc"},
    "nmt_nfkc_cf trimmed": {"rule": "nmt_nfkc_cf", "remove_extra_whitespaces": True},
    "no bytes": {"byte_fallback": False},
    "unigram": {"model_type": 1},
    "unigram nmt_nfkc no bytes": {"model_type": 1, "rule": "nmt_nfkc", "remove_extra_whitespaces": True, "byte_fallback": False},
}


@pytest.mark.parametrize("kind", KINDS)
def test_encodings_are_the_librarys(kind):
    proto = changed(**KINDS[kind])
    t, lib = Transducer(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    for x in samples():
        ids = t.encode(x).tolist()
        assert ids == lib.encode(x), (kind, x)
        if t.byte_ids:
            assert t.decode(ids) == t.normal.said(x)


def test_models_with_own_pieces_are_refused():
    m = pb.ModelProto.FromString(changed())
    m.pieces[300].type = m.pieces[300].USER_DEFINED
    with pytest.raises(ValueError, match="own"):
        Transducer(m.SerializeToString())
