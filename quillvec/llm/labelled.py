"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.session import durable


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int, key: str = "doc_id"):
    """At most ``per_class`` ``(text, label)`` rows of each label value, as an Arrow table on the driver.

    Of the keys with a text of at most ``longest`` bytes those with the smallest hash are taken: at most ``classes * per_class * longest`` bytes. A key with several labels has the greatest,
    one with several texts the one of the smallest hash.
    A label value without any such text is warned of.
    """
    once = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    once = once.groupBy(key).agg(F.max(label).cast("int").alias("__y"))
    spark = docs.sparkSession
    fits = docs.where(F.octet_length("text") <= longest)
    values = {value for (value,) in once.select("__y").distinct().collect()}
    once = durable(once.join(fits.select(key), key, "left_semi"))
    found = {value for (value,) in once.select("__y").distinct().collect()}
    if values - found:
        warnings.warn(f"{label}: no text of at most {longest} bytes for {sorted(values - found)}", stacklevel=2)
    chosen = None
    for value in sorted(found):
        some = once.where(F.col("__y") == value).orderBy(F.xxhash64(key), key).limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return spark.createDataFrame([], "text string, y int").toArrow()
    # per_class rows per class, whatever the size of the tables
    few = F.broadcast(chosen.withColumnRenamed(key, "__key"))
    texts = fits.select(F.col(key).alias("__key"), "text")
    one = texts.join(few, "__key").groupBy("__key", "__y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return one.select("text", F.col("__y").alias("y"), "__key").orderBy("__key").drop("__key").toArrow()


def kept_rows(docs: DataFrame, names: set[str], keep) -> DataFrame:
    """The rows that ``keep`` leaves of ``docs``, all columns as they came, those called like its own ``names`` too."""
    aside = [f"__own_{k}_{c}" if c.lower() in names else c for k, c in enumerate(docs.columns)]
    return keep(docs.toDF(*aside)).select(*aside).toDF(*docs.columns)
