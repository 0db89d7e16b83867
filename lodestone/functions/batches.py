"""What tasks of Python share: parts of Arrow batches whose texts are bounded, so that memory does not follow the batches' size."""

from __future__ import annotations

#: Bytes of texts that a task turns into Python's strings at once.
AT_ONCE = 1 << 21


def slices(batches, column: int = 1):
    """Slices of batches with about AT_ONCE bytes in a column each, one row at least."""
    for batch in batches:
        step = max(1, AT_ONCE * batch.num_rows // max(1, batch.column(column).nbytes))
        for begin in range(0, batch.num_rows, step):
            yield batch.slice(begin, step)
