"""Sorted Arrow batches by runs of rows that agree in some columns, whole runs at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def run_ends(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Where each run of rows with equal `names` ends; nulls are equal to each other, as are NaNs."""
    new = np.zeros(batch.num_rows - 1, dtype=bool)
    for name in names:
        codes = pc.dictionary_encode(batch.column(name), null_encoding="encode").indices.to_numpy()
        new |= codes[1:] != codes[:-1]
    return np.r_[np.nonzero(new)[0] + 1, batch.num_rows]


def whole_runs(names: Sequence[str], work: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]):
    """For `mapInArrow` over rows sorted by `names`: `work` gets whole runs and where each ends, about a batch at a time."""
    names = list(names)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []                 # of the run that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = run_ends(batch, names)
            if held and len(ends) == 1 and held[-1].select(names).slice(0, 1).equals(batch.select(names).slice(0, 1)):
                held.append(batch)
                continue
            if held:
                batch = pa.concat_batches([*held, batch])
                ends = run_ends(batch, names)
            cut = int(ends[-2]) if len(ends) > 1 else 0
            if cut:
                yield work(batch.slice(0, cut), ends[:-1])
            held = [batch.slice(cut)]
        if held:
            rows = pa.concat_batches(held)
            yield work(rows, np.array([rows.num_rows]))
    return walked
