"""Runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches, keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal values (null equals null) in the first ``keys`` columns of sorted batches, and where the runs start, with the end of the last."""
    rest = None

    def part_of(batch):
        return pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])

    def starts_of(part):
        edge = np.zeros(part.num_rows, bool)
        edge[0] = True
        for column in part.columns[:keys]:
            code = column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            edge[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(edge)

    for batch in batches:
        if batch.num_rows:
            part = part_of(batch)
            starts = starts_of(part)
            rest = part.slice(starts[-1])  # the last run may go on
            if len(starts) > 1:
                yield part.slice(0, starts[-1]), starts
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])
