"""Whole groups of sorted rows out of a stream of batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows whose groups lie together, in frames of whole groups, each with the places at which its groups begin; nulls are equal. Only the group
    that goes on in the next batch is held."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = pd.concat([held[-1].iloc[-1:], b])[by] if held else b[by]
        before = k.shift()
        new = ((k != before) & ~(k.isna() & before.isna())).any(axis=1).to_numpy()[len(k) - len(b) :]
        cuts = np.flatnonzero(new)
        if not held:
            cuts = cuts[cuts > 0]
        if len(cuts):
            whole = pd.concat([*held, b.iloc[: cuts[-1]]], ignore_index=True)
            offset = sum(map(len, held))
            if len(whole):
                yield whole, np.unique([0, *(cuts[:-1] + offset)])
            held = []
        held.append(b.iloc[cuts[-1] if len(cuts) else 0 :])
    if held:
        yield pd.concat(held, ignore_index=True), np.zeros(1, int)
