"""Dense numbering of a whole table, and fixed-size batches over it."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.session import durable, path_exists

_COUNTERS = "run string, first bigint, n bigint"

_ROW_BITS = 33  # monotonically_increasing_id holds the partition above 33 bits of row number


def with_ordinal(df: DataFrame, order: list[str], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """Adds ``name``, numbering the rows 1..N by ``order``.

    Rows are range partitioned and sorted once, and the result is checkpointed, because the
    range bounds are sampled: the count per partition and the numbering must see the same
    placement even if an executor is lost in between. Rows that agree in ``order`` are ordered
    and spread by a hash of all their columns, so one frequent value does not fill one
    partition. (A random tail could change when a task is repeated, and lose rows.)
    """
    tail = "__tail"
    keys = [*order, tail]
    ranged = df.withColumn(tail, F.xxhash64(*df.columns))
    ranged = ranged.repartitionByRange(*([partitions] if partitions else []), *keys).sortWithinPartitions(*keys)
    placed = durable(ranged.drop(tail)).withColumn("__at", F.monotonically_increasing_id())
    partition = F.shiftright("__at", _ROW_BITS)
    counts = placed.groupBy(partition.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").toArrow()
    offsets = [0, *accumulate(counts["n"].to_pylist())][:-1]
    table = pa.table({"__part": counts["__part"], "__offset": pa.array(offsets, pa.int64())})
    if table.num_rows == 0:
        return df.withColumn(name, F.lit(None).cast("bigint")).limit(0)
    # One row per partition of the checkpoint: its size is the partition count, not the data.
    by_partition = F.broadcast(df.sparkSession.createDataFrame(table))
    return (
        placed.withColumn("__part", partition)
        .join(by_partition, "__part")
        .withColumn(name, F.col("__offset") + F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1) + 1)
        .select(*df.columns, name)
    )


def with_batch(df: DataFrame, batch_size: int, ordinal: str = "idx", name: str = "batch_no") -> DataFrame:
    """Adds the number (from 0) of the fixed-size batch a numbered row falls in."""
    return df.withColumn(name, F.floor((F.col(ordinal) - 1) / batch_size).cast("bigint"))


def counters(df: DataFrame, path: str) -> DataFrame:
    """``(run, first, n)`` of every finished run below ``path``; ``df`` only lends its session."""
    spark, place = df.sparkSession, f"{path}/counters"
    found = path_exists(spark, place)
    return spark.read.schema(_COUNTERS).parquet(place) if found else spark.createDataFrame([], _COUNTERS)


def number_run(df: DataFrame, order: list[str], path: str, run: str, name: str = "idx") -> DataFrame:
    """The rows of one run numbered on from the runs before, stored below ``path``; the first run starts at 1.

    A run counts once its counter is written, which is the last step. One that is repeated gives the rows it stored before, whatever
    ``df`` is now, so a replayed micro-batch changes nothing; one that broke off is written anew. Runs come one after another:
    for streams, ``writeStream.foreachBatch(lambda df, n: number_run(df, order, path, str(n)))``.
    """
    held = counters(df, path)
    target = f"{path}/rows/run={run}"
    last, mine = held.agg(F.max(F.col("first") + F.col("n")), F.count_if(F.col("run") == run)).first()
    if not mine:
        first = last or 1
        numbered = with_ordinal(df, order, name).withColumn(name, F.col(name) + F.lit(first - 1))
        numbered.write.mode("overwrite").parquet(target)
        n = df.sparkSession.read.schema(numbered.schema).parquet(target).count()
        df.sparkSession.createDataFrame([(run, first, n)], _COUNTERS).coalesce(1).write.mode("append").parquet(f"{path}/counters")
    return df.sparkSession.read.parquet(target)
