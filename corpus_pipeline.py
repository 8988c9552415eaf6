"""A training corpus from raw documents: toxicity, language, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cascadia.llm import language, packing, simhash, suffix, toxicity
from cascadia.llm.common import DOCUMENT_COLUMNS, checkpointed, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: A language found with less certainty than this is no language.
LEAST_SCORE = 0.3


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[docs[c] for c in DOCUMENT_COLUMNS])


def _digest() -> Column:
    """A digest of all columns of a row, null told from empty."""
    short = F.to_json(F.struct(*[c for c in DOCUMENT_COLUMNS if c != "text"]), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")), short).cast("binary"), 256)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of documents that are here, doesn't call toxic."""
    return toxicity.drop_toxic(_columns(docs), table(spark, sf_dir, "labels"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is found with some certainty."""
    return language.keep_identified(_columns(docs), LEAST_SCORE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest id.

    Rows with that id in the group, repeated or with other texts, are told apart by a digest of all columns: the smallest stays, and one
    of equal rows. An id whose texts are in several groups is judged in each of them. A row without an id stays only if no row of its
    group has one.
    """
    docs = _columns(docs)
    groups = simhash.grouped(docs, key=_digest())
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("best")).select(F.col("best.key").alias("key"))
    # the join leaves the rows dealt and sorted by their digest, so equal ones are side by side
    one = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return docs.withColumn("key", _digest()).join(kept, "key", "left_semi").withColumn("one", one).where("one = 1").select(*DOCUMENT_COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document also has; bytes of a character that was cut through go with it."""
    docs = _columns(docs).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    cut = suffix.dedup(docs, keep_text=True).where("n_removed > 0").select("doc_id", "text_sha256", "kept").dropDuplicates(["doc_id", "text_sha256"])
    done = docs.join(cut, ["doc_id", "text_sha256"], "left")
    return done.select("doc_id", F.coalesce("kept", "text").alias("text"), "lang", "source", F.when(F.col("kept").isNotNull(), F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("simhash", one_of_each_group),
    ("suffix", cut_repeats),
    ("packing", pack_sequences),
]
#: SQL has no classifiers, XXH64 or tokenizers; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
