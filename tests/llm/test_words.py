"""Word hashes, token ids and packed arrays against plain Python."""

import numpy as np
import pytest

from ridgeline.llm import backoff, tokens, words

ODD = [
    None,
    "",
    " \n\t ",
    "One two  THREE\nfour.",
    "ΑΣ ΣΑΣ. İstanbul!! é ́x",
    "x<|endoftext|>y <|ENDOFTEXT|> 'S don't DON'T. a.,b.",
    "\x1c a\x1fb\x85c\xa0d 中文。字 ３.",
    "word " * 5000,
]


def plain(text):
    return (text or "").encode().lower().split()


def test_word_hashes_follow_words():
    seen = {}
    for text, found in zip(ODD, words.word_hashes([t and t.encode() for t in ODD])):
        expected = plain(text)
        assert len(found) == len(expected)
        for word, value in zip(expected, found.tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}x" for i in range(4000)).encode()
    whole = next(words.word_hashes([text]))
    monkeypatch.setattr(words, "PIECE", 500)
    assert (next(words.word_hashes([text])) == whole).all()
    long_word = b"a" * 2000 + b" b"
    assert len(next(words.word_hashes([long_word]))) == 2


def test_shingles():
    w = next(words.word_hashes([b"a b c a b c d"]))
    assert len(np.unique(words.shingle_hashes(w, 3))) == 4
    assert len(words.shingle_hashes(w[:2], 3)) == 1
    assert len(words.shingle_hashes(w[:0], 3)) == 0
    assert words.sequence_hash(w, 1) != words.sequence_hash(w[::-1].copy(), 1)


def test_ids_equal_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    whole = Tokenizer.from_file(path)
    texts = [*ODD, *(f"Ünder{i}, thér{i % 7}ing! e{'r' * (i % 5)}tion." for i in range(300))]
    expected = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(tokens, "MEMORY", 50)
    for encoder in (tokens.WordEncoder(path), tokens.encoder(path)):
        for _ in range(2):
            assert [x.tolist() for x in encoder.ids(texts)] == expected


@pytest.mark.parametrize("dtype", ["<u4", "<u8"])
def test_packed_arrays(dtype):
    for size in (0, 1, 1000):
        values = np.arange(size, dtype=dtype) * 77
        assert (backoff._unpack(backoff._pack(values), dtype) == values).all()
