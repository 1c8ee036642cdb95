"""Slices of Arrow batches; Spark bounds a batch by bytes, these bound what a function holds of it at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd


def slices(parts: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """The frames of parts in pieces of at most `rows` rows."""
    for part in parts:
        for i in range(0, len(part), rows):
            yield part.iloc[i : i + rows].reset_index(drop=True)
