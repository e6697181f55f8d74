"""SentencePiece encoding: ids, spans and decoding against the library, on any text and any ids."""

import hashlib
import random

import pytest
import sentencepiece as spm
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as formats

from docketry.llm import pieces, queries
from docketry.llm.piece_model import PieceModel

TEXTS = [
    "", " ", "  a", "a  b \n\n c\t", "▁x", " ▁▁ y▁z▁", "日本語テキスト ☃ é́", "\x00a", "x" * 3000, "<s> </s> <0x0A> <unk>",
    "12345 678" * 20, "    " * 40, "😀" * 5, "ＡＢＣ ①  é ﬁn", "Àx   ", "  á ", "　　x", "ガギ ｶﾞ", "b▁ ▁"]


def lump(rng: random.Random) -> str:
    parts = ["a", "b", " ", "▁", "\n", "é", "日", "😀", "the", "ing", "1", "<", "0x0A", ">", "\t", "ß", "ﬁ", "é"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))


def spans(library, text):
    return [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def same(model, library, texts):
    for text, (ids, begins, ends) in zip(texts, model.encode(texts)):
        assert ids.tolist() == library.encode(text), text
        assert list(zip(begins.tolist(), ends.tolist())) == spans(library, text), text


@pytest.fixture(scope="module")
def given_model():
    path = queries.piece_model_path()
    return PieceModel(path), spm.SentencePieceProcessor(model_file=path)


def test_equals_the_library(given_model):
    rng = random.Random(1)
    same(*given_model, TEXTS + [lump(rng) for _ in range(500)])


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(given_model, text):
    same(*given_model, [text])


def test_any_ids_decode(given_model):
    model, library = given_model
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260), 29871, 259]) for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule, extra, fallback", [
    ("nmt_nfkc", True, True), ("nfkc_cf", False, True), ("nfkc", True, False)])
def test_compiled_character_maps(tmp_path, rule, extra, fallback):
    """The given model with the library's own character maps in it."""
    proto, other = formats.ModelProto(), formats.ModelProto()
    with open(queries.piece_model_path(), "rb") as file:
        proto.ParseFromString(file.read())
    other.ParseFromString(spm.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = extra
    if not fallback:
        proto.trainer_spec.byte_fallback = False
        for p in proto.pieces:
            if p.type == formats.ModelProto.SentencePiece.BYTE:
                p.type, p.piece = formats.ModelProto.SentencePiece.NORMAL, "\U000f0000" + p.piece
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as file:
        file.write(proto.SerializeToString())
    model, library = PieceModel(path), spm.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    texts = TEXTS + [lump(rng) for _ in range(300)]
    same(model, library, texts)
    for text in texts:
        assert model.decode(library.encode(text)) == library.decode(library.encode(text)), text


def test_forgetting_changes_nothing(given_model, monkeypatch):
    model, library = given_model
    monkeypatch.setattr(PieceModel, "CACHED", 3)
    same(model, library, TEXTS)
    same(model, library, TEXTS[::-1])


def test_kinds_not_read(tmp_path):
    proto = formats.ModelProto()
    with open(queries.piece_model_path(), "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    path = str(tmp_path / "other.model")
    with open(path, "wb") as file:
        file.write(proto.SerializeToString())
    with pytest.raises(ValueError):
        PieceModel(path)


def test_query_on_odd_rows(spark, odd_docs, frame, tmp_path, given_model):
    from tests.llm.conftest import DOCS

    docs = frame(odd_docs, DOCS, clash=("ids", "begins", "decoded"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_piece_encoding(spark, str(tmp_path)).collect()
    _, library = given_model
    want = []
    for doc_id, text, *_ in odd_docs:
        ids = library.encode(text or "")
        digest = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), library.decode(ids))]
        want.append((doc_id, len(ids), *digest))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_decoding_apart_from_encoding(spark, odd_docs, frame):
    from tests.llm.conftest import DOCS

    path = queries.piece_model_path()
    docs = frame(odd_docs, DOCS)
    at_once = pieces.encode(docs, path, back=True).select("doc_id", "decoded")
    assert sorted(map(str, pieces.decode(pieces.encode(docs, path), path).select("doc_id", "decoded").collect())) \
        == sorted(map(str, at_once.collect()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decode(pieces.encode(docs, queries.piece_model_path()), queries.piece_model_path()).collect() == []
