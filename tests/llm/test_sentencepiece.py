import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import sentencepiece_viterbi as sp
from tidewatch.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sp.load(PATH)


@pytest.fixture(scope="module")
def reference():
    """The library's own best-path encoder over the same pieces and scores: the model's type field set to 1."""
    data = open(PATH, "rb").read()
    trainer = next(v for k, v in sp._fields(data) if k == 2)
    at = data.index(trainer)
    fields, changed = list(sp._fields(trainer)), bytearray(trainer)
    assert dict(fields)[3] == 2
    spot = trainer.index(b"\x18\x02")
    changed[spot + 1] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=data[:at] + bytes(changed) + data[at + len(trainer) :])


def ids(model, text):
    import numpy as np

    return np.frombuffer(model.encode(text), "<u4").tolist()


@pytest.mark.parametrize("text", ["Hello world", "a  b   c", " lead", "tail ", "Ünïcödé ☃ 漢字", "x\ny\n\nz", "\t", "ing ing tion", "日本語テキスト", "a" * 300])
def test_equals_library(model, reference, text):
    assert ids(model, text) == reference.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeghinorst éß\n.,▂☃", max_size=60))
def test_equals_library_on_any_text(model, reference, text):
    own, other = ids(model, text), reference.encode(text)
    score = lambda x: sum(model.score[i] for i in x)
    assert own == other or score(own) == pytest.approx(score(other))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="▁"), max_size=80))
def test_round_trip(model, text):
    assert model.decode(model.encode(text)) == text


def test_frame(spark, documents):
    texts = {1: "plain text", 2: None, 3: "", 4: "word " * 40000, 5: "plain text"}
    rows = {r["doc_id"]: r for r in sp.round_trip(documents(texts), PATH).collect()}
    assert all(r["round_trip"] for r in rows.values()) and rows[2]["n_pieces"] == rows[3]["n_pieces"] == 0
    assert rows[1]["ids_crc32"] == rows[5]["ids_crc32"]
    back = {r["doc_id"]: r["text"] for r in sp.decode_ids(sp.encode_documents(documents(texts), PATH), PATH).collect()}
    assert back == {k: v or "" for k, v in texts.items()}
    assert sp.round_trip(documents({1: "x"}).limit(0), PATH).count() == 0
