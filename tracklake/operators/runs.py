"""Sorted rows as runs: what a sequential operator needs of a partition, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_runs(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[pd.DataFrame]:
    """Batches sorted by the keys, cut so that no run of equal keys is parted: a batch and a run are all that is held."""
    held = None
    for b in batches:
        if held is not None and len(held):
            b = pd.concat([held, b], ignore_index=True)
        if not len(b):
            continue
        new = np.zeros(len(b), bool)
        new[0] = True
        for k in keys:
            v = b[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        last = int(np.flatnonzero(new)[-1])
        held = b.iloc[last:]
        if last:
            yield b.iloc[:last].reset_index(drop=True)
    if held is not None and len(held):
        yield held.reset_index(drop=True)


def spans(values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    if not len(values):
        return []
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))
