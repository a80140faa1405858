"""Baum-Welch over sequences in a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .models import HMM


def fit_frame(model: HMM, sequences: DataFrame, column: str = "x", stop: float = 1e-9, rounds: int = 10_000, local_values: int = 1 << 20) -> float:
    """Fits `model` to the arrays of a column; the log probability at the end.

    Up to `local_values` numbers in all are fitted to at the driver.  Beyond, every round sends the model to the
    tasks, which take 64 sequences at a time, and sums what they make of them: as many numbers as the model has
    come back, whatever the data."""
    rows = materialize(sequences.select(F.col(column).alias("x")).where(F.size("x") > 0), "sequences")
    n = rows.agg(F.coalesce(F.sum(F.size("x")), F.lit(0))).first()[0]
    if n <= local_values:
        # in an order of their own, so that sums don't depend on that of the rows
        return model.fit([np.array(r.x) for r in rows.orderBy("x").collect()], stop, rounds)

    def sums() -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for lo in range(0, b.num_rows, 64):
                    own = model.statistics([x.values.to_numpy(zero_copy_only=False) for x in b.column(0).slice(lo, 64)])
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "v"])

        got = rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        return np.array([r.v for r in got])

    return model.fit_by(sums, stop, rounds)
