"""A training-corpus pipeline: five stages over `documents`, each on all that the one before kept.

1. toxicity: documents that the random field scores 0.7 or more go;
2. language: documents without a recognised language (`und`) go, whatever the score; if no language can be learnt, all stay;
3. near_duplicates: one document of each component of the 5-word shingle join stays;
4. decontamination: documents with a passage of a benchmark item go;
5. tokens: the rest is encoded by byte-level BPE, and decoded again to record what the ids stand for.

Each stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of `documents`. ``run`` writes
each result as Parquet in the shared folder and reads it back for the next stage, so a lost
executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.llm import bpe_words, decontam_pigeonhole, jaccard_groups, langid_ftrl, toxicity_crf
from quillvec.session import scratch_path


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, ids, decoded_sha256)`` of every document."""
    decoded = bpe_words.decode(bpe_words.encode(docs, keys=("doc_id", "lang", "source")))
    return decoded.withColumn("decoded_sha256", F.sha2("bytes", 256)).drop("bytes")


STAGES = [
    ("toxicity", toxicity_crf.stage),
    ("language", langid_ftrl.stage),
    ("near_duplicates", jaccard_groups.stage),
    ("decontamination", decontam_pigeonhole.stage),
    ("tokens", tokens),
]

#: Trained models and the vocabulary's merges are not SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
