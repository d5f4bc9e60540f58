"""What Python workers need, and slices of an Arrow batch that bound what a task holds at a time."""
from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ROWS, CHARS = 256, 1 << 20
#: Rows of an Arrow batch, which both the JVM and the Python worker hold whole; Spark's own default is 10,000.
BATCH_ROWS = 1000


def prepare_workers(df: DataFrame) -> None:
    """Let Python workers import this package from where the driver has it, and lower the session's Arrow batches."""
    environment = df.sparkSession.sparkContext.environment
    path = [x for x in environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in path:
        environment["PYTHONPATH"] = os.pathsep.join([*path, ROOT])
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


def slices(batch: pd.DataFrame | pd.Series, column: str = "text") -> Iterator:
    """Consecutive rows with ``CHARS`` characters of text (or one row with more), ``ROWS`` rows at most.

    Working arrays take many bytes a character, so they must not grow with a batch of long texts.
    """
    texts = batch if isinstance(batch, pd.Series) else batch[column]
    ends = np.cumsum([0 if t is None or t != t else len(t) for t in texts.tolist()])
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        to = min(max(int(np.searchsorted(ends, before + CHARS, "right")), at + 1), at + ROWS)
        yield batch.iloc[at:to]
        at = to
