"""Helpers shared by the training-data operators.

Scratch tables live in the folder that the cluster names in
``spark.checkpoint.dir``; a private local folder is made only when that
setting is absent *and* the session runs in one process (tests).
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: space and TAB..CR.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once a session, for
    drivers that were started without it on the workers' path."""
    context = spark.sparkContext
    if getattr(context, "_tickwise_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tickwise_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not (master.startswith("local") and not master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
        base = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read
    it again. Recomputable input for every later job, whatever executors go."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, results, *needed: str) -> DataFrame:
    """``df`` without columns that have the names of results: those take their place."""
    if clash := {c.lower() for c in results} & {c.lower() for c in needed}:
        raise ValueError(f"columns {sorted(clash)} are read and would be replaced: rename them")
    return df.drop(*results)


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters keep their case. ``lower`` does it for strings
    of ASCII alone, many times faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def strip_blanks(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def segments(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cuts Arrow batches so that the strings of ``column`` hold about
    ``limit`` bytes a piece (one longer row is a piece of its own); only the
    piece at hand is turned into Python strings."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy()
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            piece = batch.slice(start, stop - start)
            yield piece, piece.column(column).to_pylist()
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (np.unique hashes, which is many times slower)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
