import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import pieces

from .helpers import as_tuples, documents, frame

AWKWARD = ["", " ", "  a", "a  ", " \n a", "\n\n", "▁x", "a▁ ▁b", "\x00a", "<s> </s> <unk> <0x0A>", "é́", "﻿", "　", "\U0001f600x\U0001f9ff", "a\r\n  b\t\tc", "();\r\n", "x" * 300, "中文字符测试" * 30, "  " * 40, "▁" * 9, "�͸\U000e0001", "1234567890" * 9, "x².y ².² a²b", "(word).word's—\"word\"² _word_ a-b—c e.g. [x] vs."]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.default_path())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


def same(vocabulary, library, text):
    ids = library.encode(text)
    cut = vocabulary.segments(text)
    assert [i for part in vocabulary.encode(cut) for i in part] == ids
    whole = "".join(cut)
    assert vocabulary._long(whole) == ids  # the cuts change nothing
    assert vocabulary._short([whole, *cut]) == [ids, *vocabulary.encode(cut)]
    assert vocabulary.decode(ids) == library.decode(ids)


def test_awkward_texts(vocabulary, library):
    for text in AWKWARD:
        same(vocabulary, library, text)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60) | st.text("ab \n▁\r\té中{}();0", max_size=60) | st.lists(st.sampled_from("the of and ing tion in  \n ▁ ▁▁ \r ); é ü 0x 12 \U0001f600 ͸".split(" ")), max_size=40).map("".join))
def test_agenda_is_the_library(vocabulary, library, text):
    same(vocabulary, library, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(3, 258), max_size=30))
def test_decoding_of_any_ids_is_the_library(vocabulary, library, ids):
    assert vocabulary.decode(ids) == library.decode(ids)


def test_round_trip_of_a_table(spark, library):
    rows = documents() + [(5000 + k, t, None, None, None, None, None) for k, t in enumerate(AWKWARD)]
    out = as_tuples(pieces.round_trip(frame(spark, rows)))
    assert out == sorted(((r[0], library.encode(r[1] or ""), library.decode(library.encode(r[1] or "")), 0) for r in rows), key=repr)
    back = pieces.decoded(pieces.round_trip(frame(spark, rows)))
    assert as_tuples(back) == sorted(((r[0], library.decode(library.encode(r[1] or ""))) for r in rows), key=repr)


def test_digests(spark, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = documents()
    expected = []
    for r in rows:
        ids = library.encode(r[1] or "")
        expected.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), 0))
    assert as_tuples(pieces.digests(frame(spark, rows))) == sorted(expected, key=repr)
    assert pieces.digests(frame(spark, [])).count() == 0


def test_a_difference_takes_the_library_and_is_counted(vocabulary, library):
    class Wrong(pieces.Vocabulary):
        def encode(self, segments):
            return [[5] if s == " thing" else ids for s, ids in zip(segments, super().encode(segments), strict=True)]

    coder = pieces.Coder(Wrong(pieces.default_path()))
    assert len(library.encode("thing")) == 1
    ids, texts, differs = coder.documents(["a thing", "none"])
    assert differs == [1, 0] and texts == ["a thing", "none"] and [len(i) // 4 for i in ids] == [2, len(library.encode("none"))]


def test_kept_segments_are_bounded(monkeypatch, vocabulary, library):
    monkeypatch.setattr(pieces, "KEPT", 3)
    coder = pieces.Coder(vocabulary)
    for text in ["a b c d e f g", "a b " + "y" * 100, "h i a b", "a b"]:
        ids, back, _ = coder.documents([text])
        assert back == [text] and [int.from_bytes(ids[0][k : k + 4], "little") for k in range(0, len(ids[0]), 4)] == library.encode(text)
    assert all(len(s) <= pieces.LONGEST for s in coder.known) and len(coder.known) + len(coder.older) < 16


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.default_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Vocabulary(str(path))
