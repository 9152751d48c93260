"""Recall of approximate answers, measured against exact ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.operators.search import K_VALUES


def recall_at_k(approx: DataFrame, exact: DataFrame, ks: Sequence[int] = K_VALUES) -> DataFrame:
    """``(k, n_queries, recall)``: share of each query's exact top k that was found, averaged.

    Both sides are hit tables; they are joined once, at the largest k.
    """
    top = max(ks)
    found = approx.filter(F.col("rank") <= top).select("query_id", "vec_id", F.col("rank").alias("found_rank"))
    truth = exact.filter(F.col("rank") <= top).select("query_id", "vec_id", "rank")
    pairs = truth.join(found, ["query_id", "vec_id"], "left")
    per_query = (
        pairs.withColumn("k", F.explode(F.lit(sorted(ks)).cast("array<int>")))
        .filter(F.col("rank") <= F.col("k"))
        .groupBy("query_id", "k")
        .agg((F.count_if(F.col("found_rank") <= F.col("k")) / F.count("*")).alias("recall"))
    )
    return per_query.groupBy("k").agg(F.count("*").alias("n_queries"), F.avg("recall").alias("recall"))
