"""Shared helpers: table access, checkpoints and the hash folds of the contracts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_columns(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, whatever other columns the table has."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def hash_share(place: Column, n: Column, wanted: int) -> Column:
    """Whether a 64-bit hash lies in the part of its range that holds somewhat more than ``wanted`` of ``n`` different values.

    Samples drawn so have a size that doesn't grow with the rows or the number of tasks.
    """
    share = F.least(F.lit(1.0), F.lit(1.5 * wanted + 50) / F.greatest(F.lit(1), n))
    return place / F.lit(2.0**64) + 0.5 <= share


def checkpointed(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own, and a cluster an error."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
