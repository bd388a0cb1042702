"""Python functions over Arrow columns, row by row, with results in blocks cut by bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa

BYTES = 1 << 22


def in_blocks(batches: Iterable[tuple[pa.Array, ...]], fn: Callable[..., Any], kind: pa.DataType, size: Callable[[Any], int],
              limit: int = BYTES) -> Iterator[pa.Array]:
    """``fn`` of each row, in arrays that end as soon as their results' ``size`` adds up to ``limit``.

    A task holds one row and one block of results as Python objects, however many or large the rows of a batch are.
    """
    for columns in batches:
        held, total = [], 0
        for row in zip(*columns):
            held.append(fn(*[cell.as_py() for cell in row]))
            total += size(held[-1])
            if total >= limit:
                yield pa.array(held, kind)
                held, total = [], 0
        if held:
            yield pa.array(held, kind)
        # The next batch is read while these names still hold this one.
        columns = row = held = None
        pa.default_memory_pool().release_unused()
