"""Words, and the labelled rows that the two document classifiers learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import doc_columns, fold, hash_share

EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»“”„’…¿¡"


def bare(token: str) -> str:
    """The token in lower case without signs around it."""
    return token.strip(EDGE).lower()


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, y, text) of at most ``most`` training rows, those with the smallest hash of their id.

    Rows whose fold is ``held_out`` are never read; null texts count as empty, null labels and ids are left out. Of rows with the same id the
    smallest text is taken. Texts stay on executors, which encode them for learning.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    marks = marks.where(fold(F.col("doc_id"), modulus) != held_out).distinct()
    place = F.xxhash64("doc_id", F.lit(1))
    chosen = marks.where(hash_share(place, F.lit(marks.count()), most)).orderBy(place, "doc_id", "y").limit(most)
    return doc_columns(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
