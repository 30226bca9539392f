"""Harmonic packing of token ids into sequences.

Lengths fall into reciprocal-capacity classes: class k holds lengths in
(capacity / (k + 1), capacity / k], and a bin of class k is full with exactly k pieces.
Documents may be cut, so a length that would waste room is cut down to the largest length
of the next class; only short remainders stay as they are. Each task fills the bins of all
classes on its own, with a count and an offset per class as its only state, so nothing is
shuffled. Pieces of bins that are still open when a task ends are laid end to end and cut
at sequence borders, so a task pads one last sequence besides the few tokens that the
classes leave over.

Defined cases: a null or blank text is a document of the closing id alone; a null id is
kept; repeated rows are packed each for itself; an empty table gives an empty result; other
columns are not read. Documents of any length are cut, never shortened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ridgeline.llm.tokens import encoder

CAPACITY = 2048
CLOSING_ID = 1
#: Remainders of at most capacity / SMALL tokens are not cut further.
SMALL = 16

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


def cut(length: int, capacity: int = CAPACITY, small: int = SMALL) -> list[tuple[int, int]]:
    """(piece length, class) of a document's pieces in order; class k fills a bin with k pieces."""
    pieces = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if rest * small > capacity and rest * k != capacity:
            piece = capacity // (k + 1)
            pieces.append((piece, k + 1))
            rest -= piece
        else:
            pieces.append((rest, k))
            rest = 0
    return pieces


class _Packer:
    """Bins of one task. Open bins hold at most ``capacity`` ids per class."""

    def __init__(self, first_sequence: int, capacity: int, small: int):
        self.next_sequence = first_sequence
        self.capacity = capacity
        self.small = small
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), ids.tobytes(), total, self.next_sequence, offset))
            offset += len(ids)
        self.next_sequence += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        for length, k in cut(len(ids), self.capacity, self.small):
            held = self.open.setdefault(k, [])
            held.append((doc_id, start, ids[start : start + length].copy(), len(ids)))
            start += length
            if len(held) == k:
                self._close(held)
                self.open[k] = []

    def finish(self) -> None:
        """Lay the pieces of open bins end to end."""
        sequence: list = []
        room = self.capacity
        for k in sorted(self.open):
            for doc_id, start, ids, total in self.open[k]:
                while len(ids):
                    part = ids[:room]
                    sequence.append((doc_id, start, part, total))
                    start, ids, room = start + len(part), ids[room:], room - len(part)
                    if room == 0:
                        self._close(sequence)
                        sequence, room = [], self.capacity
        if sequence:
            self._close(sequence)
        self.open = {}

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW
        )


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    closing_id: int = CLOSING_ID,
    small: int = SMALL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    ``ids`` holds little-endian unsigned 32-bit token ids. Sequence ids are unique and begin
    anew at a multiple of 2**33 in every task. Read ``docs`` from a table: a task that runs
    again must see its rows in the same order.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        packer = _Packer(TaskContext.get().partitionId() << 33, capacity, small)
        closing = np.array([closing_id], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = encode.ids(part.column(1).to_pylist())
                for doc_id, found in zip(part.column(0).to_pylist(), ids):
                    packer.add(doc_id, np.concatenate([found, closing]))
                yield packer.batch()
        packer.finish()
        yield packer.batch()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(task, SCHEMA)
