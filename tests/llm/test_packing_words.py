"""Ids of words that are tokenised once for many texts, against the whole tokenizer."""

from __future__ import annotations

import numpy as np
import pytest

from parlance.llm import packing
from parlance.llm.queries import tokenizer_path
from tests.llm import fixtures as fx

AWKWARD = [
    "", " ", "\n", "a\nb", " a  b ", "don't DON'T x' 's '' it's.", "that*** re%%% are.*** A$$$ a.b a--b 12ab ab12 x\" \"x", "É éa É. ÀÖØ ß ÿ÷ ×x",
    "<|endoftext|> <|EndOfText|> x<|endoftext|> x<|", "é Å K  a b", "a\tb\rc\x0bd", "😀 😀😀. 中文 字。", "x" * 300 + "..." + "y" * 50,
]


@pytest.mark.parametrize(("stretch", "memo"), [(packing.STRETCH_CHARS, packing.MEMO_WORDS), (7, 3)])
def test_ids_of_a_batch_are_those_of_the_tokenizer(monkeypatch, stretch, memo):
    monkeypatch.setattr(packing, "STRETCH_CHARS", stretch)
    texts = [*AWKWARD, *(t or "" for t in fx.texts())]
    tok = packing.WordTokenizer(tokenizer_path(), memo)
    want = [np.array(tok.tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(tok.batch_ids(texts)) == want == [tok.ids(t) for t in texts]
    assert len(tok.stems) <= memo and len(tok.stems.older) <= memo


def test_a_word_is_tokenised_once_for_all_its_cases_and_marks(monkeypatch):
    tok = packing.WordTokenizer(tokenizer_path())
    made, stem, slow = [], tok.stems.make, tok._slow
    tok.stems.make = lambda x: made.append(x) or stem(x)
    monkeypatch.setattr(tok, "_slow", lambda x: made.append(x) or slow(x))
    list(tok.batch_ids(["lorem Lorem lorem*** LOREM.", "Lorem, lorem%%%", "lorem"]))
    assert made == ["lorem"]
