"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

``bits`` hyperplanes give one table's key. It follows from the number of rows, so that buckets keep their size as the
input grows (up to 16 bits); the number of tables then follows from ``miss``, the allowed chance that a pair exactly at the
threshold shares no bucket. Vectors of every length are compared, each with those of its own length; a shorter one is hashed by the first
components of the same hyperplanes. Equal vectors of a label are one class before anything is compared, so copies cost no pairs.

No vector goes to a bucket. Its members are ids with a sketch, ``SKETCH`` words of further sign bits; those whose sketches differ in no more
bits than a pair at the threshold may (with a chance of ``miss`` / 10 to differ in more) are candidates, and a bucket returns one candidate link for each member at most.
The components of these links are found first. A true link never leaves such a component, so each vector is sent once, to its
component, where all pairs are compared exactly: links are counted there, and the components of the links found.

Buckets of over ``block`` classes and components of over ``part_block`` are cut into blocks by a hash, and every pair of blocks is a group of its own, so none has to fit
in one task. Pairs never leave a task.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do rows whose
label or vec_id is null; each still gets a row. Repeated vec_ids are told apart while links are counted and share
a row of the result each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from .common import checkpointed
from .graph import Roots, components, split_runs, whole_runs

TILE, SKETCH = 512, 3
#: Components whose hyperplanes are held at once.
PLANE_ROWS = 256


def vectors(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(float64 matrix, usable rows) of a list column."""
    rows = column.to_pylist()
    width = width or max((len(r) for r in rows if r), default=0)
    out, good = np.zeros((len(rows), width)), np.zeros(len(rows), bool)
    for i, r in enumerate(rows):
        if r and len(r) == width and None not in r:
            out[i] = r
            good[i] = True
    good &= np.isfinite(out).all(1)
    good[good] = (out[good] != 0).any(1)
    return out, good


def packed_vectors(column: pa.Array, kind: str = "<f8") -> tuple[np.ndarray, list[bytes]]:
    """(places, bytes) of the usable vectors of a list column, whatever their lengths."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    places, packed = [np.zeros(0, np.int64)], []
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        x, good = vectors(column.take(pa.array(at)), int(size))
        places.append(at[good])
        packed += [v.tobytes() for v in x[good].astype(kind)]
    return np.concatenate(places), packed


def sign_bits(x: np.ndarray, n: int, seed: int, planes: dict[int, np.ndarray]) -> np.ndarray:
    """On which side of ``n`` hyperplanes each row lies; ``planes`` keeps the hyperplanes' first components between calls."""
    dots = np.zeros((len(x), n))
    for first in range(0, x.shape[1], PLANE_ROWS):
        part = planes.get(first)
        if part is None:
            part = np.random.default_rng([seed, first]).standard_normal((PLANE_ROWS, n))
            if len(planes) < 16:
                planes[first] = part
        own = x[:, first : first + PLANE_ROWS]
        dots += own @ part[: own.shape[1]]
    return dots > 0


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def tables_for(bits: int, threshold: float, miss: float) -> int:
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - p))


def sketch_distance(threshold: float, miss: float) -> int:
    """The most bits in which the sketches of a pair at the threshold differ, but for a chance of ``miss``."""
    n, p = 64 * SKETCH, math.acos(threshold) / math.pi
    left = 1.0
    for far in range(n):
        left -= math.comb(n, far) * p**far * (1 - p) ** (n - far)
        if left <= miss:
            return far
    return n


class _Links(Roots):
    """Counts and components of the rows of a chunk; a row that stands for ``copies`` vectors counts as often for the rows it is linked to."""

    def __init__(self, copies: np.ndarray):
        super().__init__(len(copies))
        self.copies, self.count = copies, np.zeros(len(copies), np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.count, a, self.copies[b])
        np.add.at(self.count, b, self.copies[a])
        self.join(a, b)

    def tile(self, at: np.ndarray, bt: np.ndarray, links: np.ndarray) -> None:
        self.count[at] += links @ self.copies[bt]
        self.count[bt] += self.copies[at] @ links
        i, j = np.nonzero(links)
        self.join(at[i], bt[j])


def in_blocks(rows: DataFrame, counts: DataFrame, key: str, block: int) -> DataFrame:
    """The rows once for each pair of blocks that theirs belongs to: ``lo`` and ``hi`` are the pair, ``own`` is the row's."""
    cut = rows.join(counts.select(key, F.ceil(F.col("count") / block).cast("int").alias("blocks")), key)
    cut = cut.withColumn("own", F.pmod(F.xxhash64("rid"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "blocks")


def near_vectors(frame: DataFrame, threshold: float = 0.98, bits: int | None = None, miss: float = 1e-6, block: int = 2048, part_block: int = 256, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    rows = frame.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    n = rows.count()
    bits = bits or min(16, max(8, round(math.log2(max(2, n)) - 8)))
    tables, far = tables_for(bits, threshold, miss), sketch_distance(threshold, miss / 10)
    kind = "<f4" if rows.schema["embedding"].dataType.elementType == FloatType() else "<f8"
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                places, v = packed_vectors(b.column("embedding"), kind)
                part = b.select(["vec_id", "label"]).take(pa.array(places))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(v, pa.binary())], ["vec_id", "label", "v"])

    # the vector's length, a label and a vector of that length behind it can't be mistaken for another pair
    packed = usable.mapInArrow(pack, "vec_id long, label string, v binary").withColumn("k", F.unhex(F.sha2(F.concat(F.concat(F.length("v").cast("string"), F.lit(":"), "label").cast("binary"), "v"), 256)))
    classes = packed.groupBy("k", "label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                v = b.column("v").to_pylist()
                sizes = np.array([len(x) for x in v])
                signs = np.zeros((len(v), tables * bits + 64 * SKETCH), bool)
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    x = np.frombuffer(b"".join([v[i] for i in at]), kind).reshape(len(at), -1).astype(np.float64)
                    signs[at] = sign_bits(x, signs.shape[1], seed, planes)
                keys = (signs[:, : tables * bits].reshape(-1, tables, bits) @ (1 << np.arange(bits))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
                words = np.packbits(signs[:, tables * bits :], axis=1).view("<i8")
                yield pa.RecordBatch.from_arrays([*b.columns, keys, *[pa.array(np.ascontiguousarray(words[:, j])) for j in range(SKETCH)]], [*b.schema.names, "keys", *sketch])

    sketch = [f"s{j}" for j in range(SKETCH)]
    words = ", ".join(f"{s} long" for s in sketch)
    signed = classes.mapInArrow(sign, f"k binary, label string, v binary, first long, copies long, keys array<int>, {words}")
    signed = checkpointed(signed.withColumn("rid", F.monotonically_increasing_id()))
    members = signed.select("rid", "label", F.length("v").alias("size"), F.posexplode("keys").alias("t", "key"), *sketch)
    members = members.select(F.xxhash64("label", "size", "t", "key").alias("bucket"), "rid", *sketch).repartition("bucket").sortWithinPartitions("bucket")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "a", "b", *sketch]
        for part, hot in split_runs(batches, "bucket", block):
            if hot:
                own = {c: part.column(c).combine_chunks() for c in ("bucket", "rid", *sketch)}
                yield pa.RecordBatch.from_arrays([own["bucket"], own["rid"], pa.nulls(part.num_rows, pa.int64()), *[own[c] for c in sketch]], names)
            else:
                a, b = _candidates(part, ["bucket"], far, sketch)
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(a), pa.array(b), *[none] * SKETCH], names)

    met = checkpointed(members.mapInArrow(meet, f"bucket long, a long, b long, {words}"))
    hot = met.where("b is null").select("bucket", F.col("a").alias("rid"), *sketch)
    hot = in_blocks(hot, hot.groupBy("bucket").count(), "bucket", block).withColumn("g", F.xxhash64("bucket", "lo", "hi"))
    hot = hot.repartition("g").sortWithinPartitions("g", "bucket", "lo", "hi")

    def meet_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, ["g"]):
            a, b = _candidates(part, ["g", "bucket", "lo", "hi"], far, sketch)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    candidates = met.where("b is not null").select("a", "b").union(hot.mapInArrow(meet_blocks, "a long, b long"))
    parts = checkpointed(components(candidates).select(F.col("node").alias("rid"), F.col("root").alias("part")))
    own = signed.select("rid", "label", F.length("v").alias("size"), "first", "copies", "v").join(parts, "rid")
    routed = in_blocks(own, parts.groupBy("part").count(), "part", part_block).withColumn("g", F.xxhash64("part", "label", "size", "lo", "hi"))
    routed = routed.repartition("g").sortWithinPartitions("g", "part", "label", "size", "lo", "hi")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_runs(batches, ["g"]):
            yield from _link_chunk(chunk, threshold, kind)

    found = checkpointed(routed.mapInArrow(link, "rid long, n long, first long, root long"))
    links = found.groupBy("rid").agg(F.sum("n").alias("n"))
    counted = signed.select("k", "rid", "first", "copies").join(links, "rid", "left").select("k", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    own = checkpointed(packed.select("vec_id", "k").join(counted, "k").select("vec_id", "first", "n"))
    n_links = own.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    edges = found.where("first != root").select("first", "root").union(own.where("vec_id != first").select("vec_id", "first"))
    roots = components(edges, "first", "root").withColumnRenamed("node", "vec_id")
    out = rows.select("vec_id").join(n_links, "vec_id", "left").join(roots, "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _groups(chunk: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(first row, number of rows) of each run of equal keys."""
    new = np.ones(chunk.num_rows, bool)
    if chunk.num_rows:
        new[1:] = False
    for k in keys:
        x = chunk.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.r_[starts, chunk.num_rows])


def _pairs_in_runs(chunk: pa.Table, keys: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows to be compared, each pair once: (a, b, False) one with one, or (a, b, True) all of a with all of b, where a is b for the pairs of a tile with itself.

    With columns ``lo`` and ``hi`` a run is a pair of blocks, and only rows of different blocks are compared.
    """
    starts, sizes = _groups(chunk, keys)
    blocks = "lo" in chunk.column_names
    lo, hi, own = (chunk.column(c).to_numpy() for c in ("lo", "hi", "own")) if blocks else (None, None, None)
    group = np.repeat(np.arange(len(starts)), sizes)
    small = np.flatnonzero(sizes[group] <= 48)
    gs = group[small]
    for shift in range(1, 48):
        a = np.flatnonzero(gs[shift:] == gs[:-shift])
        if not len(a):
            break
        a, b = small[a], small[a + shift]
        if blocks:
            fit = (lo[a] == hi[a]) | (own[a] != own[b])
            a, b = a[fit], b[fit]
        yield a, b, False
    for s, size in zip(starts[sizes > 48], sizes[sizes > 48]):
        at = np.arange(s, s + size)
        same = not blocks or lo[s] == hi[s]
        left, right = (at, at) if same else (at[own[at] == lo[s]], at[own[at] == hi[s]])
        for i in range(0, len(left), TILE):
            for j in range(i if same else 0, len(right), TILE):
                yield left[i : i + TILE], right[j : j + TILE], True


def _candidates(chunk: pa.Table, keys: list[str], far: int, sketch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Links (rid, rid) that span the rows of each run whose sketches differ in ``far`` bits at most."""
    rid = chunk.column("rid").to_numpy()
    s = [chunk.column(c).to_numpy().view(np.uint64) for c in sketch]
    out = Roots(chunk.num_rows)
    for a, b, tile in _pairs_in_runs(chunk, keys):
        if tile:
            apart = sum(np.bitwise_count(x[a][:, None] ^ x[b][None, :]).astype(np.int16) for x in s)
            i, j = np.nonzero(apart <= far)
            a, b = a[i], b[j]
        else:
            near = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int16) for x in s) <= far
            a, b = a[near], b[near]
        out.join(a, b)
    root = out.all()
    linked = np.flatnonzero(root != np.arange(len(rid)))
    return rid[linked], rid[root[linked]]


def _link_chunk(chunk: pa.Table, threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    n = chunk.num_rows
    names = np.unique(chunk.column("label").to_numpy(), return_inverse=True)[1]
    chunk = chunk.set_column(chunk.column_names.index("label"), "label", pa.array(names))
    rid, first, size = (chunk.column(c).to_numpy() for c in ("rid", "first", "size"))
    v = chunk.column("v").to_pylist()

    def rows_of(at: np.ndarray) -> np.ndarray:
        return unit(np.frombuffer(b"".join([v[i] for i in at]), kind).reshape(len(at), -1).astype(np.float64))

    out = _Links(chunk.column("copies").to_numpy())
    for a, b, tile in _pairs_in_runs(chunk, ["g", "part", "label", "size", "lo", "hi"]):
        if tile:
            links = rows_of(a) @ rows_of(b).T >= threshold
            out.tile(a, b, np.triu(links, 1) if a[0] == b[0] else links)
            continue
        for width in np.unique(size[a]):
            own = size[a] == width
            p, q = a[own], b[own]
            near = np.einsum("ij,ij->i", rows_of(p), rows_of(q)) >= threshold
            out.pairs(p[near], q[near])
    linked = np.flatnonzero(out.count)
    if not len(linked):
        return
    order, root = np.full(n, np.iinfo(np.int64).max), out.all()
    np.minimum.at(order, root, first)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rid[linked], out.count[linked], first[linked], order[root[linked]])], ["rid", "n", "first", "root"])


#: Brute force over all pairs of a label.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT r.a AS vec_id, coalesce(max(n.n), 0) AS n_links, min(r.b) AS component_id, min(r.b) = r.a AS kept
FROM reach r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = r.a
GROUP BY r.a
"""
