"""Word hashes of whole texts, computed for a batch of documents at a time.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return of the UTF-8 text, with A-Z in lower case. Texts are read in pieces of
bounded size cut at white space, so memory follows the piece and not the text; only a
single word longer than a piece makes a longer piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

PIECE = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    upper = (codes >= 65) & (codes <= 90)
    codes[upper] += np.uint64(32)
    return mix((codes + np.uint64(1)) * np.uint64(_BASE))


_VALUES = _byte_values()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to ``size``."""
    have = _powers.get(0)
    if have is None or len(have[0]) <= size:
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(size + 1, base, dtype=np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        have = tables[0], tables[1]
        if size <= 2 * PIECE:
            _powers[0] = have
    return have


def _word_bounds(data: np.ndarray, space_table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = space_table[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return edges[0::2], edges[1::2]


def _span_hashes(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from starts and ends to hashes of those spans."""
    powers, inverses = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * powers[: len(data)], out=sums[1:])

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = (sums[ends] - sums[starts]) * inverses[starts]
        return mix(found + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    return hashes


def hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of one piece."""
    starts, ends = _word_bounds(data, _SPACE)
    return _span_hashes(data)(starts, ends), starts, ends


def hash_stems(data: np.ndarray, space_table: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of all words, and of the first bytes of the words longer than each length."""
    starts, ends = _word_bounds(data, space_table)
    hashes = _span_hashes(data)
    found = [hashes(starts, ends)]
    for length in lengths:
        longer = starts[ends - starts > length]
        found.append(hashes(longer, longer + length))
    return found


def pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut at white space."""
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        cut = max(text.rfind(c, start, end) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if cut <= start:
            later = [p for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (p := text.find(c, end)) >= 0]
            cut = min(later, default=len(text))
        yield text[start:cut]
        start = cut
    yield text[start:]


def word_hashes(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """One array of 64-bit word hashes per text; null and blank texts give an empty one."""
    empty = np.zeros(0, dtype=np.uint64)
    group: list[bytes] = []
    size = 0

    def flush():
        joined = np.frombuffer(b" ".join(group), dtype=np.uint8)
        hashes, starts, _ = hash_piece(joined)
        bounds = np.cumsum([len(t) + 1 for t in group])[:-1]
        yield from np.split(hashes, np.searchsorted(starts, bounds))

    for text in texts:
        text = text or b""
        if size + len(text) > PIECE and group:
            yield from flush()
            group, size = [], 0
        if len(text) > PIECE:
            parts = [hash_piece(np.frombuffer(p, dtype=np.uint8))[0] for p in pieces(text)]
            yield np.concatenate([empty, *parts])
        else:
            group.append(text)
            size += len(text) + 1
    if group:
        yield from flush()


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, in order; a shorter text is one run, an empty one none."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = mix(words[:n] + np.uint64(size))
    for k in range(1, size):
        out = mix(out * np.uint64(_BASE) + words[k : k + n])
    return out


def sequence_hash(words: np.ndarray, seed: int) -> int:
    """Hash of the whole word sequence."""
    powers, _ = _power_tables(max(len(words), 1))
    salted = mix(words + np.uint64((seed * _BASE) & _MASK))
    total = (salted * powers[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
    return int(mix(np.array([total]))[0])
