"""Vector tables: which rows take part, samples, matrices of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, id_column: str, vector_column: str, zero: bool = True) -> DataFrame:
    """(id, vector of doubles, dim) of the rows with an id and a vector of
    finite components only (``zero``: also if all are 0)."""
    v = F.col("vector")
    rows = df.select(df[id_column].cast("long").alias("id"), df[vector_column].cast("array<double>").alias("vector"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & ~bad)
    return (rows if zero else rows.where(F.exists(v, lambda x: x != 0))).withColumn("dim", F.size(v))


def matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """Rows of a list<double> column, all of ``dim`` components."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.concatenate([[0], column.value_lengths().to_numpy(zero_copy_only=False)]))[rows]
    return values[starts[:, None] + np.arange(dim)[None, :]].astype(np.float64).reshape(len(rows), dim)


def by_dim(batch: pa.RecordBatch):
    """(dim, row numbers, matrix) for each length of vector in a batch."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, matrix(batch.column("vector"), at, dim)


def sample(rows: DataFrame, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dim -> (ids, vectors) of at most ``n`` distinct rows, the first by a
    hash of id and vector; the driver holds n * dim doubles."""
    taken = rows.orderBy(F.xxhash64("id", "vector"), "id").select("id", "vector", "dim").limit(n).toArrow()
    out = {}
    for batch in taken.combine_chunks().to_batches():
        for dim, at, x in by_dim(batch):
            ids = batch.column("id").to_numpy()[at]
            first = _first_of_equal(ids, x)
            out[dim] = ids[first], x[first]
    return out


def _first_of_equal(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sort(np.unique(np.column_stack([ids.astype(np.float64), ids % 1_000_003, x]), axis=0, return_index=True)[1])


def fewest(ids: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Row numbers without repeats of (id, vector), and of each vector only the
    ``keep`` smallest ids: no later one can be among the keep - 1 best of any
    query, whatever the query."""
    if not len(ids):
        return np.empty(0, np.int64)
    same = np.unique(x, axis=0, return_inverse=True)[1].reshape(-1)
    order = np.lexsort((ids, same))
    same, own = same[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (same[1:] != same[:-1]) | (own[1:] != own[:-1])
    order, same = order[new], same[new]
    start = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    place = np.arange(len(same)) - np.repeat(start, np.diff(np.append(start, len(same))))
    return np.sort(order[place < keep])


def best(found: DataFrame, k: int) -> DataFrame:
    """Per query the k highest scores, ties to the smaller vec_id, ranked from 1."""
    order = Window.partitionBy("query_id", "print").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
