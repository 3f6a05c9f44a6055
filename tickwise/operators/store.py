"""Stored results in whole versions.

A store is a folder with data and a log. Each append writes its rows to a data
folder of its own and then one log row; each invalidation writes one log row
alone, with its pattern and the appends that it saw; a compaction writes what
is left of some folders to a new one, and a log row that replaces them. A log
row is one small file, there or not there: what stops before it leaves the
store as it was, and what stops after it is done. Nothing is overwritten, so a
reader that has taken a ``Version`` goes on reading it whatever comes after.

Writers need no lock. An invalidation deletes what it saw, so an append that
runs beside it survives whole; rows keep the name of the append they came
from, so this also holds across a compaction that runs beside both. Of two
compactions of the same folders the first in the order of names counts, the
other is ignored by all readers.

Layout for key lookups: rows are ranged by key, sorted, and have Parquet bloom
filters on the key, so a probe (``probe``) reads the row groups that may hold
its key and a glob those between its prefix's bounds; folders per indicator
inside. Log and version are driver-sized: one row for each write since the
last compaction.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .results import key_matches

KEY, ORIGIN = "params_key", "written_by"
APPEND, INVALIDATE, COMPACT = "append", "invalidate", "compact"
_LOG = ("id string, kind string, at timestamp, columns string, pattern string, seen array<string>, replaces array<string>, "
        "origins array<string>, applied array<string>")


@dataclass(frozen=True)
class Folder:
    """A data folder: the appends its rows come from and the invalidations that it has left out already."""
    id: str
    columns: str
    origins: frozenset
    applied: frozenset


@dataclass(frozen=True)
class Version:
    """What a store holds at one time."""
    path: str
    folders: tuple
    invalidations: tuple  # (id, pattern, appends seen)

    @property
    def appends(self) -> frozenset:
        return frozenset().union(*[f.origins for f in self.folders])


def _name() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def _commit(spark: SparkSession, path: str, name: str, kind: str, **values) -> None:
    fields = T.StructType.fromDDL(_LOG).names
    row = {"id": name, "kind": kind, **values}
    log = spark.createDataFrame([tuple(row.get(f) for f in fields)], _LOG).withColumn("at", F.current_timestamp())
    log.coalesce(1).write.parquet(f"{path}/log/{name}")


def _write(rows: DataFrame, path: str, name: str) -> None:
    ranged = rows.repartitionByRange("indicator", KEY).sortWithinPartitions("indicator", KEY)
    (ranged.write.partitionBy("indicator").option(f"parquet.bloom.filter.enabled#{KEY}", "true")
     .option(f"parquet.bloom.filter.adaptive.enabled#{KEY}", "true").parquet(f"{path}/data/{name}"))


def append(results: DataFrame, path: str, cached_at) -> str:
    """Add results with their write time; returns the append's name."""
    name = _name()
    rows = results.withColumns({"cached_at": F.lit(cached_at).cast("timestamp"), ORIGIN: F.lit(name)})
    _write(rows, path, name)
    _commit(results.sparkSession, path, name, APPEND, columns=rows.schema.json(), origins=[name])
    return name


def version(spark: SparkSession, path: str) -> Version:
    """The store as it is now."""
    log = spark.read.schema(_LOG).option("recursiveFileLookup", "true").parquet(f"{path}/log")
    entries = sorted(log.collect(), key=lambda r: r["id"])  # one row for each write
    folders = {r["id"]: Folder(r["id"], r["columns"], frozenset(r["origins"]), frozenset(r["applied"] or ())) for r in entries if r["kind"] != INVALIDATE}
    gone: set[str] = set()
    for r in entries:
        if r["kind"] == COMPACT:
            if gone.isdisjoint(r["replaces"]) and r["id"] not in gone:
                gone.update(r["replaces"])
            else:
                gone.add(r["id"])
    live = tuple(f for name, f in folders.items() if name not in gone)
    return Version(path, live, tuple((r["id"], r["pattern"], frozenset(r["seen"])) for r in entries if r["kind"] == INVALIDATE))


def _left(v: Version, f: Folder) -> tuple:
    """Invalidations that a folder's readers have to apply."""
    return tuple((pattern, seen & f.origins) for name, pattern, seen in v.invalidations if name not in f.applied and seen & f.origins)


def _kept(rules: tuple, origins: frozenset) -> Column:
    """Rows that no invalidation has deleted (a null key matches nothing)."""
    gone = [F.coalesce(key_matches(pattern, KEY), F.lit(False)) & (F.lit(True) if seen == origins else F.col(ORIGIN).isin(*sorted(seen))) for pattern, seen in rules]
    return reduce(lambda a, b: a & ~b, gone, F.lit(True))


def read(spark: SparkSession, path: str, at: Version | None = None) -> DataFrame | None:
    """The rows of a version (default: now), None before the first append.
    Filters on key and indicator reach the scan."""
    v = at or version(spark, path)
    groups: dict[tuple, list[Folder]] = {}
    for f in v.folders:
        groups.setdefault((f.columns, _left(v, f) and (_left(v, f), f.origins)), []).append(f)
    parts = []
    for (columns, rules), folders in groups.items():
        schema = T.StructType.fromJson(json.loads(columns))
        one = reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{v.path}/data/{f.id}") for f in folders])
        parts.append(one.where(_kept(*rules)) if rules else one)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def probe(spark: SparkSession, path: str, keys: list[str], at: Version | None = None) -> DataFrame:
    """The rows of a few keys; the scan leaves out row groups by bounds and bloom filters."""
    return read(spark, path, at).where(F.col(KEY).isin(*keys))


def invalidate(spark: SparkSession, path: str, pattern: str, at: Version | None = None) -> int:
    """Delete the keys that match the glob, of all appends in ``at``
    (default: those there now), and return how many distinct keys they are."""
    v = at or version(spark, path)
    rows = read(spark, path, v)
    if rows is None:
        return 0
    deleted = rows.where(key_matches(pattern, KEY)).agg(F.count_distinct(KEY)).first()[0]
    if deleted:
        _commit(spark, path, _name(), INVALIDATE, pattern=pattern, seen=sorted(v.appends))
    return deleted


def compact(spark: SparkSession, path: str, at: Version | None = None) -> str | None:
    """Write what is left of a version's folders into one, without the deleted rows."""
    v = at or version(spark, path)
    rows = read(spark, path, v)
    if rows is None:
        return None
    name = _name()
    _write(rows, path, name)
    _commit(spark, path, name, COMPACT, columns=rows.schema.json(), replaces=[f.id for f in v.folders], origins=sorted(v.appends), applied=[i for i, _, _ in v.invalidations])
    return name
