from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from prose import prose
from tokenizers import Tokenizer, models, pre_tokenizers

from hornspark.llm import packing, token_counts
from hornspark.llm.queries import digest

PATH, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.text(st.sampled_from("ab cdé  \n\t\r\x0b\x1c\x85 ​12'sdtlmreve<|endoftext|>!?ß中😀▁"), max_size=40)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def unigram():
    pieces, unknown = token_counts.vocabulary(PIECES)
    t = Tokenizer(models.Unigram(pieces, unknown, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    return t, token_counts.Counter(pieces, unknown)


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(PATH)


@given(TEXTS)
@settings(max_examples=1500, deadline=None)
def test_ids_equal_the_library(library, encoder, text):
    assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == library.encode(text, add_special_tokens=False).ids


@given(TEXTS)
@settings(max_examples=1500, deadline=None)
def test_counts_equal_the_library(unigram, text):
    tokenizer, counter = unigram
    assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_counts_are_near_those_of_the_files_own_tokenizer(unigram):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = (
        "The quick brown fox jumps over the lazy dog", "tokenization of internationalization",
        "It is a truth universally acknowledged, that a single man in possession of a good fortune, must be in want of a wife.",
        "Call me Ishmael. Some years ago, never mind how long precisely, having little or no money in my purse, I thought I would sail about a little.",
    )
    for text in plain:
        assert abs(unigram[1].count(text) - len(own.encode(text))) <= 1 + len(text) // 80
    assert unigram[1].count("<s>") == 3  # a control piece's text is ordinary text


@pytest.mark.parametrize("unit", ["中文没有空格", "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo", "ꙮ"])
def test_long_texts_without_spaces(unigram, unit):
    text = unit * (200_000 // len(unit))
    assert unigram[1].count(text) == len(unigram[0].encode(text, add_special_tokens=False).ids)
    assert all(len(w) <= token_counts.KEPT_LENGTH for w in unigram[1])


def test_kept_words_are_bounded(monkeypatch, unigram, encoder):
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 3)
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    text = prose(50, 3)
    assert unigram[1].count(text) == len(unigram[0].encode(text).ids) and len(unigram[1]) <= 3
    encoder.encode(text)
    assert len(encoder) <= 3


ROWS = [(1, prose(900, 1)), (2, None), (3, ""), (4, "x" * 20_000), (5, prose(3000, 2)), (5, "again"), (5, "again"), (None, "no id"), (6, " \n ")]


@pytest.mark.parametrize("length", [16, 1024])
def test_packing_loses_nothing(docs, library, monkeypatch, length):
    monkeypatch.setattr(packing, "BATCH_BYTES", 3000)
    pieces = [r.asDict() for r in digest(packing.pack(docs(ROWS).repartition(3), PATH, length=length)).collect()]
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
        by_doc[p["doc_id"]].append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == length or s == len(by_sequence) - 1 and at < length
    wanted = defaultdict(list)
    for i, t in ROWS:
        wanted[i].append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    for i, docs_ in wanted.items():
        assert sum(p["length"] for p in by_doc[i]) == sum(map(len, docs_))
        if len(docs_) == 1:
            at = 0
            for p in sorted(by_doc[i], key=lambda p: p["start"]):
                ids = docs_[0][at : at + p["length"]]
                assert p["start"] == at and p["doc_tokens"] == len(docs_[0]) and p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
                at += p["length"]
    assert packing.pack(docs([]), PATH).collect() == []


def test_token_counts_table(docs, unigram):
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(docs(ROWS), PIECES).collect()), key=repr)
    assert got == sorted(((i, len(unigram[0].encode(t or "").ids)) for i, t in ROWS), key=repr)
    assert token_counts.token_counts(docs([]), PIECES).collect() == []
