"""What the tasks of the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Return the memory that this process has freed, and its allocators still hold, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(task: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task for mapInArrow that gives freed memory back when it ends.

    Spark keeps its Python workers and takes them in turn, more of them than run at once; each would hold what its largest task took, in later
    stages too, in which only the JVM works.
    """

    def run(batches):
        last = None
        for last in task(batches):
            yield last
        if last is not None:
            last = pa.RecordBatch.from_arrays([pa.array([], f.type) for f in last.schema], schema=last.schema)
            yield last  # without rows: whoever writes the batches holds the one before, and what it is a slice of, until the next comes
        give_back()

    return run
