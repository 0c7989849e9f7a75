"""Arrow-batch plumbing shared by the operators that run Python code."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled in one vectorised step; a longer text is a step of its own.
STEP_BYTES = 500_000


def steps(*columns: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts in all `columns` together stay below `limit` bytes."""
    size = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype("int64") for c in columns)
    begin = total = 0
    for i, n in enumerate(size.tolist()):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if len(size) > begin:
        yield begin, len(size)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal `keys`, across batch borders.

    The input is sorted by the keys within the partition. A group is held until
    its last row came; the callers bound the rows of a group.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        borders = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(borders, borders[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
