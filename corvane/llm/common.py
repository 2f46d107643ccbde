"""What the training-data operators share: reading, fresh column names, row keys, linking."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans.runtime import new_path

# The white space that separates words: space and the five control characters from tab to carriage return.
# It is also what Python's bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"
TEXTS_IN_A_BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called that (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's values, never null; equal rows have equal keys."""
    return F.xxhash64(*columns)


@contextmanager
def short_batches(spark: SparkSession, rows: int = TEXTS_IN_A_BATCH) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is executed meanwhile: whole texts are large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(name)
    spark.conf.set(name, str(min(int(given), rows) if int(given) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, given)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage like a checkpoint, in less space."""
    path = new_path(df.sparkSession, name)
    with short_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a[i], b[i]) as a forest of stars: (child, root) for every end that is not its component's smallest.

    At most one row per end, so a group of m linked values leaves as m - 1 rows, however many links it had.
    """
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(ends))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            break
        low = np.minimum(rx, ry)
        np.minimum.at(root, rx, low)
        np.minimum.at(root, ry, low)
        while (jumped := root[root] != root).any():
            root[jumped] = root[root[jumped]]
    child = root != np.arange(len(ends))
    return ends[child], ends[root[child]]
