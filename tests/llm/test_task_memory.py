"""What a task holds of the texts of a batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from ridgeline.llm import minhash
from ridgeline.llm.arrow import text_bytes


def peak(run):
    tracemalloc.start()
    for _ in run():
        pass
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return most


class Tasks:
    """Takes the place of a DataFrame and keeps the function that it is mapped by."""

    def select(self, *columns):
        return self

    def mapInArrow(self, task, schema):
        return task


def test_texts_of_a_batch_are_read_by_slices():
    column = pa.array([f"{i:04d}" * 1000 for i in range(4000)] + [None, ""])
    assert peak(lambda: text_bytes(column)) < 4 << 20  # the texts are 16 MB
    assert list(text_bytes(column)) == column.cast(pa.large_binary()).to_pylist()
    assert list(text_bytes(column.slice(3990))) == column.slice(3990).cast(pa.large_binary()).to_pylist()
    assert list(text_bytes(column.slice(0, 0))) == []


def test_sketches_do_not_hold_whole_sets():
    words = " ".join(f"w{i}" for i in range(2500))
    batch = pa.record_batch([pa.array(range(3000)), pa.array([words] * 3000)], names=["doc_id", "text"])
    one = batch.slice(0, 300)
    for task in (minhash.signatures(Tasks(), 5, 64), minhash.profiles(Tasks(), 5)):
        # The sets are 20 kB each: 54 MB more if they are all held.
        assert peak(lambda: task(iter([batch]))) < peak(lambda: task(iter([one]))) + (30 << 20)
        found = next(task(iter([one])))
        assert set(found.column(1).to_pylist()) == {2496}
        assert (np.diff(found.column("sketch")[0].as_py()) > 0).all()
