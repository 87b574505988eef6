"""Pieces and offsets against the library."""

import pytest
import sentencepiece
from llm_helpers import frame, odd_rows, sha, tuples
from sentencepiece import sentencepiece_model_pb2

from wildtally.llm import pieces, registry

TEXTS = ["", " ", "  a  b ", "plain text", "x\x00y\n\n z", "▁ literal ▁▁", "日本語 😀 é é", "\t\ttabs", "a" * 5000, "ﬁ ①"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=registry.model_path())


def test_like_the_library(spark, library):
    rows = list(enumerate(TEXTS)) + [(i + 1000, t) for i, t in odd_rows()] + [(None, "x"), (5, "x")]
    found = tuples(pieces.digests(frame(spark, rows), registry.model_path()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    expected = []
    for doc, text in rows:
        ids = library.encode(text or "")
        expected.append((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert pieces.digests(frame(spark, []), registry.model_path()).collect() == []


def test_spans_cover_the_source(spark, library):
    for row in pieces.encoded(frame(spark, list(enumerate(TEXTS))), registry.model_path()).collect():
        data = TEXTS[row.doc_id].encode()
        assert row.decoded == library.decode(row.ids)
        assert not row.begins or (row.begins[0] == 0 and row.ends[-1] == len(data) and row.begins[1:] == row.ends[:-1])
        for i, a, b in zip(row.ids, row.begins, row.ends):
            piece = library.id_to_piece(i)
            if not library.is_byte(i):
                assert piece.lstrip("▁") == data[a:b].decode().replace("▁", " ").lstrip(" ")


def test_character_map():
    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(rules.serialized_model_proto())
    chars = pieces.CharMap(spec.normalizer_spec.precompiled_charsmap)
    for text in ["ﬁne ＡＢＣ①㍿", "한국어 ｶﾞ ㌔x", "plain", "é"]:
        mapped, source = chars.apply(text.encode())
        assert "▁" + mapped.decode().replace(" ", "▁") == rules.normalize(text)
        assert len(source) == len(mapped) + 1 and list(source) == sorted(source) and source[-1] == len(text.encode())
    assert chars.apply("ﬁ".encode())[1].tolist() == [0, 0, 3]
