"""Many small groups in one task: batches of sorted rows cut between groups, so that a kernel takes whole batches of them at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def dealt(rows: DataFrame, by: list[str], order: list[str] | None = None) -> DataFrame:
    """rows dealt by group to a number of tasks that isn't coalesced (few bytes, much work), sorted for whole_groups()."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *by).sortWithinPartitions(*by, *(order or []))


def first_rows(pdf: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Where another group begins, the first row included; nulls are equal."""
    out = np.zeros(len(pdf), dtype=bool)
    for c in by:
        now, before = pdf[c], pdf[c].shift()
        out |= ((now != before) & ~(now.isna() & before.isna())).to_numpy(dtype=bool)
    out[:1] = True
    return out


def whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, number of each row's group, from 0) of batches sorted by group; no group is in two. A task holds a batch and one group."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        begins = first_rows(pdf, by)
        if held:
            begins[0] = first_rows(pd.concat([held[-1].iloc[-1:], pdf.iloc[:1]]), by)[1]
        at = np.flatnonzero(begins)
        if not len(at):
            held.append(pdf)
            continue
        parts = [p for p in (*held, pdf.iloc[: at[-1]]) if len(p)]
        held = [pdf.iloc[at[-1] :]]
        if parts:
            own = pd.concat(parts, ignore_index=True)
            yield own, np.cumsum(first_rows(own, by)) - 1
    if held:
        own = pd.concat(held, ignore_index=True)
        yield own, np.zeros(len(own), dtype=np.int64)
