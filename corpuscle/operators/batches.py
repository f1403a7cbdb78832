"""Arrow batches in parts of bounded bytes, for maps in Python whose objects take several times a batch's size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def parts(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Each batch halved until a part has at most `most` bytes or one row, in order; no part is empty."""
    for batch in batches:
        todo = [batch] if batch.num_rows else []
        while todo:
            part = todo.pop()
            n = part.num_rows
            if n == 1 or part.nbytes <= most:
                yield part
            else:
                todo += [part.slice(n // 2), part.slice(0, n // 2)]
