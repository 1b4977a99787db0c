import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import _bpe, packing

from .helpers import documents, frame

ODD = ["It's <|endoftext|> we'll 123 ÀÉ café ½ x² 日本語 İstanbul Σας áb \xa0x　y", "", "don't!!!...", "AAAA" * 50, "ß µ ª º", "x\x1cy \x85z", "'s'S'T 'Re", "q" * 49 + " " + "q" * 48]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 400), st.integers(1, 9000), st.sampled_from([255, 256, 257, 2047, 2048, 2049, 4096])), max_size=60))
def test_every_token_once_and_no_padding(lengths):
    seen = [np.zeros(n, int) for n in lengths]
    for pieces in packing.pack(lengths):
        size = sum(p[2] for p in pieces)
        assert 0 < size <= 2048 and size & (size - 1) == 0
        for doc, start, n in pieces:
            assert n > 0
            seen[doc][start : start + n] += 1
    assert all((s == 1).all() for s in seen)


def test_ids_equal_the_tokenizer():
    tokens = _bpe.tokens(packing.default_path())
    full = Tokenizer.from_file(packing.default_path())
    texts = ODD + [r[1] or "" for r in documents()]
    ids, first = tokens.documents([t.encode() for t in texts])
    assert tokens.merging
    for k, text in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == full.encode(text, add_special_tokens=False).ids


def test_pieces_round_trip(spark):
    full = Tokenizer.from_file(packing.default_path())
    rows = [(k, *r[1:]) for k, r in enumerate(documents())]
    docs = frame(spark, rows)
    out = packing.packed(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text, *_ in rows:
        ids = np.array([*full.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    groups = {}
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].tier and at & (at - 1) == 0
        groups[pieces[0].step_group] = groups.get(pieces[0].step_group, 0) + at
    assert max(groups.values()) <= packing.STEP_TOKENS


def test_step_groups_are_full(spark):
    rows = [(k, *r[1:]) for k, r in enumerate(documents(n=200))]
    out = packing.packed(frame(spark, rows), step_tokens=4096).collect()
    tokens, lengths = {}, {}
    for r in out:
        tokens[r.step_group] = tokens.get(r.step_group, 0) + r.length
        lengths.setdefault(r.step_group, set()).add(r.tier)
    assert all(len(x) == 1 for x in lengths.values())
    short = [min(lengths[g]) for g, n in tokens.items() if n != 4096]
    assert len(short) == len(set(short))  # only the last group of a length


def test_empty_table(spark):
    assert packing.packed(frame(spark, [])).count() == 0
