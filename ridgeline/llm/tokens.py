"""Token ids of the public word BPE vocabulary, with a memory of words.

The vocabulary's normaliser and splitter never look across white space, so the ids of a
text are the ids of its words in order, and A-Z count as a-z. Words repeat; each worker
keeps the ids of the words it has met under their 64-bit hashes and encodes only new ones.
A plain Latin word with closing punctuation is two pieces for the splitter; such pieces go
to the merges directly, many at a time. Every other word takes the tokenizer's whole way,
and so do whole texts that could spell one of its special tokens.
"""

from __future__ import annotations

import os
import re

import numpy as np

from ridgeline.llm.words import PIECE, hash_piece, pieces

#: Words a worker remembers (about 50 bytes each); a full memory starts anew, which costs
#: time and changes nothing.
MEMORY = 1_500_000
#: Bytes of text that are looked up together.
GROUP = 1 << 21

_PLAIN = re.compile(
    "([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:;=-@\\[-`{-~]*)"
)
_JOIN = 500

_loaded: dict[str, "WordEncoder"] = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level vocabularies (a fixed format)."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    table = {b: b for b in kept} | {b: 256 + i for i, b in enumerate(moved)}
    del table[32]
    return table


class WordEncoder:
    """Little-endian unsigned 32-bit ids of texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        self._merges = Tokenizer(self._whole.model)
        self._merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self._keys = np.zeros(0, dtype=np.uint64)
        self._starts = np.zeros(0, dtype=np.int64)
        self._lengths = np.zeros(0, dtype=np.int64)
        self._flat = np.zeros(0, dtype="<u4")

    def _encode_pieces(self, wanted: set[str]) -> dict[str, bytes]:
        """Ids of splitter pieces (lower case, no white space), encoded many to a call."""
        todo = list(wanted)
        encoded: dict[str, bytes] = {"": b""}
        lines = [" ".join(todo[i : i + _JOIN]) for i in range(0, len(todo), _JOIN)]
        lines = [x.encode().decode("latin-1").translate(self._letters) for x in lines]
        at = 0
        for found in self._merges.encode_batch(lines, add_special_tokens=False):
            ids = np.array(found.ids, dtype="<u4")
            owner = np.array(found.word_ids)
            cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(ids)]
            raw = ids.tobytes()
            for start, end in zip(cuts[:-1], cuts[1:]):
                encoded[todo[at]] = raw[4 * start : 4 * end]
                at += 1
        return encoded

    def _encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        plain, other = [], []
        for i, word in enumerate(words):
            if parts := _PLAIN.fullmatch(word):
                plain.append((i, parts[1].lower(), parts[2]))
            else:
                other.append(i)
        known = self._encode_pieces({p for _, *parts in plain for p in parts if p})
        for i, stem, tail in plain:
            out[i] = known[stem] + known[tail]
        for i, found in zip(other, self._whole.encode_batch([words[i] for i in other], add_special_tokens=False)):
            out[i] = np.array(found.ids, dtype="<u4").tobytes()
        return out

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        if len(self._keys) + len(keys) > MEMORY:
            self._forget()
        encoded = self._encode_words(words)
        lengths = np.array([len(x) // 4 for x in encoded], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths + len(self._flat)
        order = np.argsort(both := np.concatenate([self._keys, keys]), kind="stable")
        self._keys = both[order]
        self._starts = np.concatenate([self._starts, starts])[order]
        self._lengths = np.concatenate([self._lengths, lengths])[order]
        self._flat = np.concatenate([self._flat, np.frombuffer(b"".join(encoded), dtype="<u4")])

    def _unknown(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self._keys, keys)
        found = at < len(self._keys)
        found[found] = self._keys[at[found]] == keys[found]
        return ~found

    def _ids_of(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words of ``data``, where each word starts in it, and the number of its ids."""
        hashes, starts, ends = hash_piece(np.frombuffer(data, dtype=np.uint8))
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        for _ in range(2):
            new = np.flatnonzero(self._unknown(keys))
            if len(new) == 0:
                break
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist())
            self._learn(keys[new], [data[a:b].decode() for a, b in spans])
        at = np.searchsorted(self._keys, keys)[inverse]
        lengths = self._lengths[at]
        before = np.cumsum(lengths) - lengths
        spots = np.arange(lengths.sum()) + np.repeat(self._starts[at] - before, lengths)
        return self._flat[spots], starts, lengths

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null and blank texts have none."""
        out: list[np.ndarray] = []
        group: list[bytes] = []
        size = 0

        def flush() -> None:
            found, starts, lengths = self._ids_of(b" ".join(group))
            bounds = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in group])[:-1])
            before = np.concatenate([[0], np.cumsum(lengths)])
            out.extend(np.split(found, before[bounds]))

        for text in texts:
            special = text is not None and "<|" in text
            data = (text or "").encode()
            if group and (special or size + len(data) > GROUP):
                flush()
                group, size = [], 0
            if special:
                ids = self._whole.encode(text, add_special_tokens=False).ids
                out.append(np.array(ids, dtype="<u4"))
            elif len(data) > PIECE:
                if group:
                    flush()
                    group, size = [], 0
                out.append(np.concatenate([self._ids_of(p)[0] for p in pieces(data)]))
            else:
                group.append(data)
                size += len(data) + 1
        if group:
            flush()
        return out


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
