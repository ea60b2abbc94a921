"""Arrow batches of rows that are sorted by event, cut between events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_events(batches: Iterator[pa.RecordBatch], rows_out: int) -> Iterator[pa.Table]:
    """Tables of whole events, of so many rows or one event at least; the first column is the event."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows_out:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table[0].to_numpy()
        whole = int(np.searchsorted(ids, ids[-1]))  # the last event may go on in the next batch
        if whole:
            yield table.slice(0, whole)
        else:
            rows_out = 2 * len(ids)  # an event that is larger than all that is held is copied as seldom as it doubles
        held, size = table.slice(whole).to_batches(), len(ids) - whole
    if held:
        yield pa.Table.from_batches(held)
