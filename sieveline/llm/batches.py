"""Arrow batches in portions: what a task holds as Python objects stays small whatever the batch size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

ROWS = 400


def portions(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, without copies; an empty batch is passed on as it is."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()
