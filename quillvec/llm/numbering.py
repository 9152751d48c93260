"""Row numbers without gaps for tables that are read more than once."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.session import stored

_ROW_BITS = 33  # monotonically_increasing_id holds the partition above 33 bits of row number


def numbered(df: DataFrame, name: str, label: str) -> tuple[DataFrame, int]:
    """The rows written once to the shared folder with numbers 0..N-1 in ``name``, and N.

    Nothing is shuffled: a row's number is its place in its task plus the rows of the tasks before. Numbers
    are read from the stored table, never made again by a later scan, so a lost executor changes none.
    """
    held = stored(df.withColumn(name, F.monotonically_increasing_id()), label)
    counts = held.groupBy(F.shiftright(name, _ROW_BITS).alias("task")).agg(F.count("*").alias("n")).orderBy("task").toArrow()
    sizes = counts["n"].to_pylist()
    if not sizes:
        return held, 0
    # One row per task that wrote the table.
    before = pa.table({"__task": counts["task"], "__before": pa.array([0, *accumulate(sizes)][:-1], pa.int64())})
    placed = held.withColumn("__task", F.shiftright(name, _ROW_BITS)).join(
        F.broadcast(df.sparkSession.createDataFrame(before)), "__task"
    )
    number = F.col("__before") + F.col(name).bitwiseAND((1 << _ROW_BITS) - 1)
    return placed.withColumn(name, number).select(*held.columns), sum(sizes)
