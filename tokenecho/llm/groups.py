"""Groups of rows that are compared inside tasks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stretches(members: DataFrame, parts: Column) -> DataFrame:
    """members(id, ...) with (i, j, sub): a group of `parts` stretches is compared in pairs of stretches.

    Rows of a group are dealt to stretches by id, and each goes to every pair (i, j) with its own.
    """
    out = members.withColumn("parts", parts.cast("int")).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    out = out.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.withColumn("i", F.least("sub", "with")).withColumn("j", F.greatest("sub", "with")).drop("parts", "with")


def _changes(batch: pa.RecordBatch, key: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Rows with which a group begins."""
    change = np.zeros(batch.num_rows, bool)
    for k in key:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
        change[0] |= last is not None and last.column(k)[last.num_rows - 1].as_py() != v[0]
    return change


def whole_groups(batches, key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that are sorted by key, and where each group starts."""
    held: list[pa.RecordBatch] = []
    starts: list[np.ndarray] = [np.zeros(1, np.int64)]
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.flatnonzero(_changes(batch, key, held[-1] if held else None))
        if at.size:  # all groups but the last are whole
            z = int(at[-1])
            n = sum(b.num_rows for b in held)
            if n + z:
                yield pa.Table.from_batches([*held, batch.slice(0, z)]), np.concatenate([*starts, at[:-1] + n])
            held, starts = [], [np.zeros(1, np.int64)]
            batch = batch.slice(z)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held), starts[0]


def by_group(batches, key: list[str]) -> Iterator[pa.Table]:
    """One table for each group."""
    for t, starts in whole_groups(batches, key):
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]):
            yield t.slice(a, z - a)


def reached(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest label in reach of each row over the links (a, b) of rows; label holds row numbers."""
    while a.size:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        left = label[a] != label[b]
        a, b = a[left], b[left]
    while (label[label] != label).any():
        label = label[label]
    return label
