"""What the two vector operators share: which vectors count, and rows of Arrow lists as matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)`` of rows with an id and a vector of finite components, not all zero; ``v`` is an array of doubles."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & some)


def matrix(col) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def lists(m: np.ndarray, kind=None) -> pa.ListArray:
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(np.ascontiguousarray(m).ravel(), kind))


def by_groups(keys: tuple[str, ...], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """Work on rows that come sorted by ``keys``, one group at a time; groups must be bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not t.num_rows:
                continue
            cols = [t[k].to_numpy() for k in keys]
            cuts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols], axis=0)) + 1).tolist()]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                yield from work(t.slice(lo, hi - lo))
            rest = t.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield from work(rest)

    return run
