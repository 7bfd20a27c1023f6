"""Ids of texts from kept pieces against the tokenizer on whole texts."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framegrid.llm import packing

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["the", "élan", "Ünß", "I'll", "they've", "'s", "12", "3.14", "...", "¿qué?", "a\x00b", "<|endoftext|>", "日本", "º", "", " ", "  ", "\n", "\r\n", "\t", " \n ", "\xa0", "qzxwvk" * 30]


@pytest.fixture(autouse=True)
def fresh(monkeypatch):
    monkeypatch.setattr(packing, "_pieces", {})


def whole(texts):
    t = Tokenizer.from_file(TOKENIZER)
    return [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


@pytest.mark.parametrize("joined", [True, False])
def test_kept_pieces_give_the_ids_of_whole_texts(monkeypatch, joined):
    if not joined:
        monkeypatch.setattr(packing, "_joiner", lambda *_: None)
    monkeypatch.setattr(packing, "CACHED_PIECES", 20)
    rng = np.random.default_rng(5)
    texts = [str(rng.choice(["", " "])).join(rng.choice(SIGNS, int(rng.integers(0, 30))).tolist()) for _ in range(300)]
    want = whole(texts)
    for at in range(0, 300, 25):
        assert packing.token_bytes(texts[at : at + 25], TOKENIZER) == want[at : at + 25]
    assert packing.token_bytes([], TOKENIZER) == []


def test_frequent_pieces_are_encoded_once_more_at_most(monkeypatch):
    """Where more pieces are kept than there is room for, those that came first stay."""
    monkeypatch.setattr(packing, "CACHED_PIECES", 100)
    asked, encode = [], packing._piece_ids
    monkeypatch.setattr(packing, "_piece_ids", lambda pieces, *a: asked.extend(pieces) or encode(pieces, *a))
    often = "".join(f" often{c}" for c in "abcdefghij")
    for k in range(40):
        rare = "".join(f" rare{chr(97 + k % 26)}{chr(97 + k // 26)}{c}" for c in "abcdefghij")
        assert packing.token_bytes([often, rare], TOKENIZER) == whole([often, rare])
        assert packing.token_bytes([often, rare], TOKENIZER) == whole([often, rare])
    assert asked.count(" oftena") == 2
    assert len(packing._pieces[TOKENIZER, False][0]) <= 100 + 20
