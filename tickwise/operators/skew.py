"""Joins and rankings that keep a hot key out of one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], row: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Equi-join with a ``right`` of one row per key (an aggregate, so adaptive
    execution cannot split its side): each right row is repeated ``salts``
    times and the left rows of a key are dealt over them by ``row``."""
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "__salt"], how).drop("__salt")


def apart(key: str, row: str) -> Column:
    """``key`` as a string to join by, where rows without one, which meet
    nothing, are told apart by ``row``: they don't all land in the task that
    null hashes to. The other side's keys must not begin with "none "."""
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("none "), F.col(row).cast("string")))


def first_n(df: DataFrame, keys: list[str], order: list[str], limit: str, row: str, rank: str = "__rank", salts: int = SALTS) -> DataFrame:
    """Rows among the first ``limit`` (a column) of their key, with their rank.

    Ranked in two steps, first within (key, salt): only rows that can be among
    the first of their key go on to the key's own task, so that gets at most
    limit * ``salts`` rows however hot the key is."""
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int")).repartition(*keys, "__salt")
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    few = dealt.withColumn(rank, F.row_number().over(part)).where(F.col(rank) <= F.col(limit)).drop("__salt", rank).repartition(*keys)
    return few.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= F.col(limit))
