"""Connected components of a link table by alternating large and small stars.

Labels, links and components stay distributed; every round is one written
table in the shared folder, and only whether it is settled reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import written


SALTS = 8  # a hub's neighbours are dealt over so many tasks


def _meet(pairs: DataFrame, lows: DataFrame) -> DataFrame:
    """(u, v, low): pairs with the least node that ``lows`` has for u."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    copies = lows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, ["u", "salt"]).select("u", "v", "low")


def _least(pairs: DataFrame) -> DataFrame:
    """Each node with the least of its neighbours and itself."""
    return pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to a least node, which has none: then
    each component is one star."""
    nodes = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    return nodes.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up + low > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (u, v), long, in any direction -> (u, low): the least node of the
    component of every linked node but that one itself."""
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: larger neighbours move to the least node around; small star: so do a node and its smaller neighbours.
        large = _meet(both, _least(both)).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        lows = _least(large)
        small = _meet(large, lows).select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(lows.select("u", F.col("low").alias("v")))
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc")
    return edges.select("u", F.col("v").alias("low"))
