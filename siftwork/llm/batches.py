"""Arrow batches in bounded portions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 1000
#: Bytes of a portion, about, unless a single row has more.
BYTES = 8 << 20


def portions(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in portions of at most `rows` rows, fewer where rows are long, so that what a task holds beside a batch stays small."""
    for b in batches:
        n = max(1, min(rows, size * max(1, b.num_rows) // max(1, b.nbytes)))
        for lo in range(0, b.num_rows, n):
            yield b.slice(lo, n)
