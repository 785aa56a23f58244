"""Bounded groups in sorted Arrow batches, without one Python call per group from Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def key_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` (integer) columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        change = np.zeros(len(batch), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change), len(batch)]
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(cuts[-2]))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def rows_per_batch(most_rows: int, types: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of at most `most_rows`."""
    kept: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*kept), types)], schema=types)

    for row in rows:
        kept.append(row)
        if len(kept) >= most_rows:
            yield out()
            kept = []
    if kept:
        yield out()
