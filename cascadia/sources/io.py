"""Readers, writers and the feature store."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | StructType, header: bool = True, separator: str = ",", rows: int | None = None) -> DataFrame:
    """Typed text tables; headerless ones take their names from the schema. ``rows`` reads the first rows only, as the caller asks."""
    df = spark.read.csv(path, schema=schema, header=header, sep=separator, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    return df if rows is None else df.limit(rows)


def read_tsv(spark: SparkSession, path: str, schema: str | StructType, header: bool = True) -> DataFrame:
    return read_csv(spark, path, schema, header, "\t")


def read_lines(spark: SparkSession, path: str, name: str = "term") -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", name)


def read_labels(spark: SparkSession, path: str, kind: str = "int") -> DataFrame:
    """One number in each line."""
    return spark.read.text(path).select(F.trim("value").cast(kind).alias("label"))


def read_vocabulary(spark: SparkSession, path: str, most: int = 1_000_000) -> list[str]:
    """The lines of one file in order; a vocabulary is bounded."""
    terms = [r[0] for r in spark.read.text(path, wholetext=True).collect()]
    lines = terms[0].splitlines() if terms else []
    if len(lines) > most:
        raise ValueError(f"over {most} terms")
    return lines


def from_memory(spark: SparkSession, data: object, schema: str | StructType | None = None) -> DataFrame:
    """pandas frames, NumPy arrays and lists."""
    return spark.createDataFrame(data, schema)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, header=header)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def save_json(spark: SparkSession, value: object, path: str) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path).first()[0])


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir for tables that a query writes and reads. Where that is unset, a local session gets a folder of its own, and a cluster an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        place = tempfile.mkdtemp(prefix="shared-")
    return f"{place.rstrip('/')}/{uuid.uuid4().hex}"


class FeatureStore:
    """Feature tables by key, bucketed so that look-ups of large tables need no shuffle of the store.

    Batch look-ups are left joins; point look-ups read the buckets of their keys. ``queries`` counts the rows looked up.
    """

    def __init__(self, spark: SparkSession, database: str = "default", buckets: int = 64, folder: str | None = None):
        """``folder`` holds the tables' files, which the cluster must share; None: the warehouse."""
        self.spark, self.database, self.buckets, self.folder = spark, database, buckets, folder

    def _name(self, table: str) -> str:
        return f"{self.database}.features_{table}"

    def load(self, table: str, features: DataFrame, key: str) -> None:
        """Replaces the table; keys must be unique."""
        writer = features.write.mode("overwrite").bucketBy(self.buckets, key).sortBy(key)
        if self.folder:
            writer = writer.option("path", f"{self.folder}/{table}-{uuid.uuid4().hex}")
        writer.saveAsTable(self._name(table))

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table))

    def batch(self, table: str, rows: DataFrame, key: str, counter: Observation | None = None) -> DataFrame:
        """The rows with the table's features; missing keys get nulls."""
        asked = rows.observe(counter, F.count(F.lit(1)).alias("queries")) if counter else rows
        return asked.join(self.table(table), key, "left")

    def point(self, table: str, key: str, value: object) -> dict | None:
        found = self.table(table).where(F.col(key) == F.lit(value)).head(1)
        return found[0].asDict() if found else None


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose rows grow a lot in what follows, dealt anew if it has fewer parts than there are cores; large tables stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.isStreaming or scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
