"""Character and word n-gram features in long form: (row_id, idx, value).

Where the vocabulary is given, only its own grams are looked for (``known_grams``) or grams meet it right behind their explode, so others never reach
a shuffle. Where it is learnt, grams are counted by document once (``document_counts``), and both the vocabulary and the values come from these counts;
short character grams are so many that ``fitted_char_tfidf`` reads the texts twice instead, and only totals of grams reach a shuffle.
A vocabulary is broadcast only if its plan bounds its rows, as a fitted one's ``max_features`` does.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .ranks import bounded, most_rows, small_table

MOST_FEATURES, CHUNK = 1_000_000, 32
#: A sign takes 21 bits, so three fit in a long; a text is counted by pieces of so many signs; a task holds so many rows of totals or output.
SIGN_BITS, PACKED, PIECE, MOST_HELD = 21, 3, 1 << 17, 1 << 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A to Z only; other letters stay."""
    return F.translate(c, _UPPER, _LOWER)


def collapse_spaces(c: Column) -> Column:
    """Runs of two or more white-space signs become one space."""
    return F.regexp_replace(c, r"\s\s+", " ")


def word_clean(c: Column) -> Column:
    """Runs of signs that belong to no word become one space, in any script."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " ")


def words(c: Column, least_length: int = 1) -> Column:
    return F.filter(F.split(word_clean(c), " "), lambda w: F.length(w) >= least_length)


def char_grams(df: DataFrame, row_id: str, text: Column, low: int, high: int) -> DataFrame:
    """(row_id, term) for every overlapping n-gram of every n in [low, high].

    The text is cut into pieces of ``CHUNK`` signs that show the next ones too, so taking a gram scans one short piece
    and everything behind the cut is generated code.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{CHUNK + high - 1}}})).{{1,{CHUNK}}}"), F.lit(1))
    made = df.select(row_id, F.explode(pieces).alias("_c")).select(row_id, "_c", F.char_length("_c").alias("_n"))
    made = made.select(row_id, "_c", "_n", F.explode(F.array(*[F.lit(n) for n in range(low, high + 1)])).alias("_k")).where(F.col("_n") >= F.col("_k"))
    starts = F.explode(F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.col("_n") - F.col("_k") + 1))).alias("_i")
    return made.select(row_id, "_c", "_k", starts).select(row_id, F.substring("_c", F.col("_i"), F.col("_k")).alias("term"))


def word_ngrams(tokens: Column, low: int, high: int) -> Column:
    def grams(n: int) -> Column:
        last = F.size(tokens) - n
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))

    return tokens if (low, high) == (1, 1) else F.concat(*[grams(n) for n in range(low, high + 1)])


def grams(df: DataFrame, row_id: str, column: str, analyzer: str, ngram_range: tuple[int, int], lowercase: bool = False, least_length: int = 2) -> DataFrame:
    """(row_id, term), one row for each occurrence. Null text has none."""
    text = ascii_lower(F.col(column)) if lowercase else F.col(column)
    if analyzer == "char":
        made = char_grams(df.select(F.col(row_id), collapse_spaces(text).alias("_t")), row_id, F.col("_t"), *ngram_range)
    elif analyzer == "word":
        # the array of one keeps the words from being computed again inside the n-gram expressions
        tokens = df.select(F.col(row_id), F.explode(F.array(words(text, least_length))).alias("_w"))
        made = tokens.select(row_id, F.explode(word_ngrams(F.col("_w"), *ngram_range)).alias("term"))
    else:
        raise ValueError(analyzer)
    return made


def _one_of(terms: Sequence[str]) -> str:
    """A pattern of the terms as a tree of their signs."""
    heads: dict[str, list[str]] = {}
    for t in terms:
        heads.setdefault(t[:1], []).append(t[1:])
    return "|".join(re.escape(head) + (f"(?:{_one_of(tails)})" if any(tails) else "") for head, tails in sorted(heads.items()))


def known_grams(df: DataFrame, row_id: str, column: str, terms: Sequence[str], lowercase: bool = False) -> DataFrame:
    """(row_id, term) for every occurrence of the terms, overlapping ones too, as the character grams of a text that are among them. Terms are bounded by the caller.

    One pattern for each length looks ahead from every position, so a row yields only the grams that count.
    """
    by_length: dict[int, list[str]] = {}
    for t in terms:
        if t:
            by_length.setdefault(len(t), []).append(t)
    text = collapse_spaces(ascii_lower(F.col(column)) if lowercase else F.col(column))
    found = [F.regexp_extract_all("_t", F.lit(f"(?=({_one_of(own)}))"), F.lit(1)) for _, own in sorted(by_length.items())]
    # the array of one keeps the text from being cleaned for each pattern
    return df.select(F.col(row_id), F.explode(F.array(text)).alias("_t")).where("_t is not null").select(row_id, F.explode(F.concat(*found)).alias("term"))


def document_counts(occurrences: DataFrame, row_id: str) -> DataFrame:
    """(row_id, term, n): how often each term occurs in each document."""
    return occurrences.where("term is not null").groupBy(row_id, "term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(spark: SparkSession, terms: Sequence[str]) -> DataFrame:
    """(term, idx) in the order given."""
    return small_table(spark, [(t, i) for i, t in enumerate(terms)], "term string, idx int")


def smooth_idf(n_docs: Column | int, df: Column) -> Column:
    return F.log((1.0 + n_docs) / (1.0 + df)) + 1.0


def with_idf(vocab: DataFrame, counts: DataFrame, n_docs: int) -> DataFrame:
    """(term, idx, idf): the terms of a vocabulary with their document frequency in the counts."""
    found = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    made = bounded(vocab).join(found, "term", "left").select("term", "idx", smooth_idf(n_docs, F.coalesce("df", F.lit(0))).alias("idf"))
    rows = most_rows(vocab)
    return made if rows is None else made.limit(rows)  # a term has one frequency, which the plan doesn't know


def fit_vocabulary(counts: DataFrame, row_id: str, n_docs: int, min_df: int = 1, max_features: int = MOST_FEATURES, stop_words: Sequence[str] = ()) -> DataFrame:
    """(term, df, tf, idf, idx): terms in at least ``min_df`` documents, the most frequent ``max_features``, numbered alphabetically. Takes counts or occurrences."""
    counts = counts if "n" in counts.columns else document_counts(counts, row_id)
    kept = counts.where(~F.col("term").isin(list(stop_words))) if stop_words else counts
    stats = kept.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf")).where(F.col("df") >= min_df)
    top = stats.orderBy(F.desc("tf"), "term").limit(max_features)
    # ranked after the limit: max_features rows at most
    return top.select("term", "df", "tf", smooth_idf(n_docs, F.col("df")).alias("idf"), (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"))


def _in_vocabulary(found: DataFrame, row_id: str, vocab: DataFrame, columns: list[str]) -> DataFrame:
    """(row_id, the vocabulary's columns, n) from counts, or from occurrences, which are counted behind the join."""
    joined = found.join(bounded(vocab.select("term", *columns), MOST_FEATURES), "term")
    if "n" in found.columns:
        return joined.select(row_id, *columns, "n")
    return joined.groupBy(row_id, *columns).agg(F.count(F.lit(1)).alias("n"))


def count_vectorize(found: DataFrame, row_id: str, vocab: DataFrame) -> DataFrame:
    """(row_id, idx, value): how often each vocabulary term occurs. Takes counts or occurrences."""
    return _in_vocabulary(found, row_id, vocab, ["idx"]).select(row_id, "idx", F.col("n").alias("value"))


def tfidf(found: DataFrame, row_id: str, vocab: DataFrame) -> DataFrame:
    """(row_id, idx, value): counts times idf, with L2 norm 1 for each row that has a term. Takes counts or occurrences."""
    raw = _in_vocabulary(found, row_id, vocab, ["idx", "idf"]).select(row_id, "idx", (F.col("n") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(row_id)))
    return raw.select(row_id, "idx", (F.col("raw") / norm).alias("value"))


def _packed(signs: np.ndarray, low: int, high: int) -> Iterator[np.ndarray]:
    """The grams of a text as longs in order, by pieces: signs from the highest bits on, each plus 1, so the longs are in the order of the grams' UTF-8."""
    for start in range(0, len(signs), PIECE):
        own = signs[start : start + PIECE + high - 1]
        places = min(PIECE, len(own))
        made, key = [], np.zeros(places, np.int64)
        for n in range(1, min(high, len(own)) + 1):
            last = min(places, len(own) - n + 1)
            key = key[:last] | own[n - 1 : n - 1 + last] << SIGN_BITS * (PACKED - n)
            if n >= low:
                made.append(key)
        if made:
            keys = np.concatenate(made)
            keys.sort()
            yield keys


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and how often each occurs, of keys in order."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)])


def _gram_counts(text: str | None, low: int, high: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A text's grams and how often each occurs; with ``known``, grams in order, only those, as their places there."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return none
    found = []
    for keys in _packed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1, low, high):
        if known is None:
            found.append(_counted(keys))
        elif len(known) <= len(keys):
            n = np.searchsorted(keys, known, "right") - np.searchsorted(keys, known)
            at = np.flatnonzero(n)
            found.append((at, n[at]))
        else:
            own, n = _counted(keys)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[at] == own
            found.append((at[hit], n[hit]))
        if len(found) > 16:
            found = [_summed(*map(np.concatenate, zip(*found)))]
    found = [f for f in found if len(f[0])]
    return none if not found else found[0] if len(found) == 1 else _summed(*map(np.concatenate, zip(*found)))


def _gram_totals(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each gram of a task's texts in how many texts it is, and how often. A task with very many different grams tells a part of its totals several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def total() -> tuple[np.ndarray, ...]:
            return _summed(*map(np.concatenate, zip(*held)))

        for batch in batches:
            for text in batch.column(1):
                keys, n = _gram_counts(text.as_py(), low, high)
                if len(keys):
                    held.append((keys, np.ones_like(n), n))
                    size += len(keys)
                if size > MOST_HELD:
                    held = [total()]
                    size = len(held[0][0])
                    if size > MOST_HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["key", "df", "tf"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in total()], ["key", "df", "tf"])

    return run


def _gram_rows(low: int, high: int, value: str, known: np.ndarray | None = None, idf: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row id, key, n) for each text's grams or, as places, the known ones; with ``idf`` the values of TF-IDF in place of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held, size = batch.column(0), batch.column(1), [], 0
            for i in range(len(texts)):
                keys, n = _gram_counts(texts[i].as_py(), low, high, known)
                if idf is not None and len(keys):
                    n = n * idf[keys]
                    n = n / np.sqrt((n * n).sum())
                if len(keys):
                    held.append((np.full(len(keys), i), keys, n))
                    size += len(keys)
                if held and (size > MOST_HELD or i == len(texts) - 1):
                    at, keys, n = map(np.concatenate, zip(*held))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(keys), pa.array(n)], [batch.schema.names[0], "key", value])
                    held, size = [], 0

    return run


def fitted_char_tfidf(df: DataFrame, row_id: str, column: str, ngram_range: tuple[int, int], min_share: float = 0.0, max_features: int = MOST_FEATURES) -> DataFrame:
    """(row_id, idx, value) by a vocabulary of character grams learnt from the rows: those in ``min_share`` of them, the most frequent ``max_features``, numbered alphabetically.

    Grams of up to three signs are packed into longs and counted text by text: totals of each task are added up for the vocabulary, then each text is
    counted again by it, without a shuffle. Rows that share an id are one document, so only their counts are brought together.
    """
    low, high = ngram_range
    ids = df.groupBy(F.col(row_id).alias("_id")).agg(F.count(F.lit(1)).alias("_rows"))
    n, most = ids.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.max("_rows")).first()
    if high > PACKED:
        counts = document_counts(grams(df, row_id, column, "char", ngram_range), row_id)
        return tfidf(counts, row_id, fit_vocabulary(counts, row_id, n, math.ceil(n * min_share), max_features))
    kind = dict(df.dtypes)[row_id]
    single, several = df.select(row_id, collapse_spaces(F.col(column)).alias("_t")), None
    if (most or 0) > 1:
        shared = F.col(row_id).eqNullSafe(F.col("_id"))
        again = ids.where("_rows > 1").select("_id")
        single, several = single.join(again, shared, "left_anti"), single.join(again, shared, "left_semi")
    totals = single.select(row_id, "_t").mapInArrow(_gram_totals(low, high), "key long, df long, tf long")
    if several is not None:
        counts = several.mapInArrow(_gram_rows(low, high, "n"), f"`{row_id}` {kind}, key long, n long").groupBy(row_id, "key").agg(F.sum("n").alias("n"))
        totals = totals.unionByName(counts.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf")))
    stats = totals.groupBy("key").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where(F.col("df") >= math.ceil(n * min_share))
    top = stats.orderBy(F.desc("tf"), "key").limit(max_features).select("key", smooth_idf(n, F.col("df")).alias("idf")).toArrow().sort_by("key")
    known, idf = (top.column(c).to_numpy() for c in ("key", "idf"))
    made = single.mapInArrow(_gram_rows(low, high, "value", known, idf), f"`{row_id}` {kind}, key long, value double")
    if several is not None:
        counts = several.mapInArrow(_gram_rows(low, high, "n", known), f"`{row_id}` {kind}, key long, n long").groupBy(row_id, "key").agg(F.sum("n").alias("n"))
        numbered = small_table(df.sparkSession, [(i, i, float(x)) for i, x in enumerate(idf)], "key long, idx long, idf double")
        made = made.unionByName(tfidf(counts.withColumnRenamed("key", "term"), row_id, numbered.withColumnRenamed("key", "term")).withColumnRenamed("idx", "key"))
    return made.select(row_id, F.col("key").cast("int").alias("idx"), "value")
