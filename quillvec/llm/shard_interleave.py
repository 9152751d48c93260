"""Sharding by proportional stratified interleaving.

Rows are shuffled inside each source by a seeded hash; the row of rank r among n takes the place
(2r + 1) / 2n on a line from 0 to 1. The line of all sources together is cut into shards of equal
row counts (at most one apart), so each shard holds every source in the proportion of the whole
table, to within a few rows.

Both rankings are range partitionings with per-partition offsets (``with_ordinal``): a source with
a third of all rows is spread over many tasks, no window ever holds a whole source.

Defined cases: a null source is a source of its own; a null text has size 1 and the crc of no
bytes; rows that agree in everything are interchangeable; an empty table gives an empty result;
columns outside the named ones are ignored unless ``carry`` names them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.operators.ordinal import with_ordinal

SHARDS = 16
SEED = 20240607
LAW = "rows"


def interleave(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    stratum: str = "source",
    key: str = "doc_id",
    text: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``(key, stratum, *carry, size, text_crc32, shard, slot)``: the place of every row.

    ``slot`` counts from 0 without gaps in each shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        F.col(stratum),
        *carry,
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    stratum_key = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null"))
    rows = rows.withColumn("__s", stratum_key).withColumn("__h", F.xxhash64(F.lit(seed), key, "text_crc32", "size"))
    kept = [key, stratum, *carry, "size", "text_crc32"]

    ranked = with_ordinal(rows, ["__s", "__h", key], "__at")
    strata = ranked.groupBy("__s").agg(F.min("__at").alias("__from"), F.count("*").alias("__n"))
    rank = F.col("__at") - F.col("__from")
    placed = ranked.join(strata, "__s").select(*kept, "__s", "__h", ((2 * rank + 1) / (2 * F.col("__n"))).alias("__f"))

    line = with_ordinal(placed, ["__f", "__s", "__h", key], "__at")
    total = line.count()
    at = F.col("__at") - 1
    shard = F.expr(f"(__at - 1) * {shards} div {max(total, 1)}")
    first = F.expr(f"(((__at - 1) * {shards} div {max(total, 1)}) * {total} + {shards - 1}) div {shards}")
    return line.select(*kept, shard.cast("int").alias("shard"), (at - first).cast("bigint").alias("slot"))


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return interleave(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
