"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, found by vector approximations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free, take_turn, with_values, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a coordinate's cell in the approximation of an entry.
BITS = 3
#: Vectors that a worker holds bounds for at once.
HELD = 2048


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector and all components are there and finite; v: floor(scale * x) of each."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ints = F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))).cast("int"))
    return vectors.where(vector.isNotNull() & finite).select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), ints.alias("v"))


def first_entries(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part, entry, place) from the vectors of the smallest ids; rows without an id come last, repeated ids by vector."""
    rows = np.array([r["v"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()], np.int64)
    if rows.ndim != 2 or rows.shape[1] % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    return rows.reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()


class Approximation:
    """The entries of one codebook with a cell for each coordinate: a place's range of values is cut into 2**bits cells."""

    def __init__(self, book: np.ndarray, bits: int = BITS):
        self.book, cells = book, 1 << bits
        low, high = book.min(axis=0), book.max(axis=0)
        edges = low[:, None] + (high - low + 1)[:, None] * np.arange(cells + 1) // cells  # cell k: edges k to k+1, the last one left out
        self.cell = np.array([np.searchsorted(edges[d], book[:, d], side="right") - 1 for d in range(book.shape[1])]).reshape(book.shape[1], -1)
        self.first, self.last = edges[:, :-1], edges[:, 1:] - 1

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance that an entry's cells allow, for each row of x and entry."""
        below, above = self.first[None] - x[:, :, None], x[:, :, None] - self.last[None]
        nearest = np.maximum(np.maximum(below, above), 0) ** 2  # tables: row, place, cell
        farthest = np.maximum(np.abs(below), np.abs(above)) ** 2
        place = np.arange(x.shape[1])[:, None]
        return nearest[:, place, self.cell].sum(axis=1), farthest[:, place, self.cell].sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of each row of x, ties to the lower entry, and how many whole distances that took."""
        lower, upper = self.bounds(x)
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        away = np.full(lower.shape, np.iinfo(np.int64).max)
        away[row, entry] = ((x[row] - self.book[entry]) ** 2).sum(axis=1)
        best = away.argmin(axis=1)
        return best, away[np.arange(len(x)), best], len(row)


def components(column: pa.Array, books: np.ndarray) -> np.ndarray:
    """A batch of vectors as (row, part, place)."""
    dim = books.shape[0] * books.shape[2]
    if any(n != dim for n in column.value_lengths().unique().to_pylist()):
        raise ValueError(f"vectors must have one length; {dim} was seen first")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(x) and dim * 4 * max(int(np.abs(x).max()), 1) ** 2 >= 1 << 63:
        raise ValueError("components are too large for squared distances in 64 bits")
    return x.reshape(len(column), books.shape[0], books.shape[2])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            yield batch.slice(at, HELD)


def improved(kept: DataFrame, books: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Codebooks after one round: entries become the floors of the means of their parts; unused ones stay.

    A task hands on one row for each component of each entry, so sums are merged by Spark and the driver gets as many
    rows as the codebooks have components, whatever the number of vectors.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("vectors")
        near = [Approximation(b, bits) for b in books]
        total, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in slices(batches):
            x = components(batch.column(0), books)
            for p in range(parts):
                best = near[p].nearest(x[:, p])[0]
                np.add.at(total[p], best, x[:, p])
                n[p] += np.bincount(best, minlength=entries)
        used = np.flatnonzero(np.repeat(n.ravel(), width))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used]), pa.array(np.repeat(n.ravel(), width)[used])], ["slot", "total", "n"])

    sums = kept.select("v").mapInArrow(run, "slot bigint, total bigint, n bigint").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    flat = books.ravel().copy()
    for r in sums.collect():
        flat[r["slot"]] = r["total"] // r["n"]
    return flat.reshape(books.shape)


def encode(kept: DataFrame, books: np.ndarray, bits: int = BITS) -> DataFrame:
    """(vec_id, label, code, error) of each vector: its entries' numbers in part order, two hex digits each, and the sum of
    its parts' squared distances from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("vectors")
        near = [Approximation(b, bits) for b in books]
        for batch in slices(batches):
            x = components(batch.column(2), books)
            found = [a.nearest(x[:, p]) for p, a in enumerate(near)]
            code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = np.sum([f[1] for f in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error.astype(np.int64))], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, bits: int = BITS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector that is whole: product codes in whole numbers.

    Entries are approximated by cells of their coordinates (a VA-file): for each part of a vector, tables of what a cell
    is away from it at least and at most give bounds of its distance from every entry, and whole distances are taken of
    those entries alone whose bounds overlap the best. The result is that of all distances.

    Rows whose vector is null or has null or non-finite components are left out. With fewer vectors than entries the
    codebooks are shorter; no vectors give no rows. Repeated ids are rows of their own; null labels are one label.
    Vectors of several lengths, a length that is no multiple of `parts` and components whose squares don't fit in 64 bits
    are errors. Other columns are not looked at.
    """
    kept = written(whole_vectors(vectors, scale=scale), "vectors")
    if kept.isEmpty():
        books = np.zeros((parts, 0, 0), np.int64)
        coded = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    else:
        books = first_entries(kept, parts, entries)
        for _ in range(rounds):
            books = improved(kept, books, bits)
        coded = written(encode(kept, books, bits), "vector-codes")
    none, key = free(coded.columns, "none"), free(coded.columns, "key")
    coded = coded.withColumn(none, F.col("label").isNull()).withColumn(key, F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = coded.groupBy(none, key).agg(F.sum("error").alias("label_error"))
    out = with_values(coded.drop("label"), sums, [none, key])
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
