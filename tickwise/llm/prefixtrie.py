"""Conversation prefix trie over range-partitioned shards (operator 13).

A conversation is the path of its turns; every distinct beginning of a path is
a node of one trie. Paths are sorted over all shards: splitters from a bounded
sample cut the order (path, conversation id) into ranges, and the splitters go
to every task. A node can only have members in two shards if it lies on a
splitter, so the trie of the splitters' paths is the *skeleton*: each shard
builds its own part of the trie from its sorted paths and finishes all other
nodes alone; skeleton nodes leave one partial row a shard, which are reduced by
a grouped aggregate, and the sums over their subtrees by doubling steps (each
step adds what stands 2^k levels below, so a depth of d takes log2(d) steps).

A turn is known by the MD5 of its role and text, 16 bytes, so paths compare as
binary strings. A splitter is cut to the first turn that tells it from the
sample before it, so that the skeleton is as small as the sharing allows; equal
paths are split between conversation ids, so a group of copies spreads over
shards. What a task holds is its shard: about ``SHARD_TURNS`` turns.

Cases: null roles and texts are empty; turns order by number, null first, ties
by the MD5 of role and text; a repeated row is a turn more; rows with a null id
belong to no conversation; a conversation left without turns is a member of the
root; ids of any sign (remainders as in SQL, with the sign of the id); very
long texts count as one turn each; the turns of one conversation stand in one
row (20 bytes a turn), and copies that agree in more than ``SAMPLE_TURNS`` turns
stay in one shard; an empty table has no nodes; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickwise.llm.common import read, ship, written

TURN = 16  # bytes of a turn in a path
SHARD_TURNS = 100_000
MAX_SHARDS = 4_096
SAMPLE = 16_384  # paths that splitters are chosen from
SAMPLE_TURNS = 512  # of each of them
ENDS = 50_000  # conversation ids in one row of a skeleton node's list
BROADCAST_NODES = 200_000  # 32 bytes each
_FIRST = -(1 << 63)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


# --- paths --------------------------------------------------------------------


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (k, w): the
    turn's MD5 in hexadecimal digits and its words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    k = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", k.alias("k"), F.regexp_count(text, F.lit(WORD)).alias("w")).alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.transform("t", lambda t: F.struct(t["k"].alias("k"), t["w"].alias("w"))).alias("turns"))


def rebuilt(own: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c %
    ``group``, h = crc32(c) % ``heads``: conversations that share beginnings."""
    first = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, heads).alias("__head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    met = own.withColumns({"__base": F.col("conv_id") - F.col("conv_id") % group, "__h": h}).join(first, "__base", "left")
    head = F.coalesce(F.slice("__head", F.lit(1), F.col("__h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("__h") + 1, F.greatest(F.size("turns") - F.col("__h"), F.lit(0)))
    return met.select("conv_id", F.concat(head, rest).alias("turns"))


def paths(own: DataFrame) -> DataFrame:
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["k"]), ""))
    return own.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["w"]).alias("words"))


# --- splitters ----------------------------------------------------------------


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    i = 0
    while a[i:i + TURN] == b[i:i + TURN]:
        i += TURN
    return i // TURN


def splitters(stored: DataFrame, shards: int | None = None) -> list[tuple[bytes, int]]:
    """Lower ends (path, conversation id) of all shards but the first, from a
    bounded sample, so that each has about as many turns."""
    spark = stored.sparkSession
    n, turns = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()
    if shards is None:
        # Three a partition, as shards are dealt to partitions by a hash.
        shards = min(MAX_SHARDS, max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS)))
    if n == 0 or shards < 2:
        return []
    cut = F.substring("key", 1, TURN * SAMPLE_TURNS)
    taken = stored.select(cut.alias("key"), F.octet_length("key").alias("size"), "conv_id")
    taken = taken.orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLE).collect()  # bounded: SAMPLE rows of SAMPLE_TURNS turns
    sample = sorted((bytes(r["key"]), _FIRST if r["size"] > len(r["key"]) else r["conv_id"], r["size"] // TURN + 1) for r in taken)
    ends = np.cumsum([w for _, _, w in sample])
    places = np.searchsorted(ends, ends[-1] * np.arange(1, shards) / shards, "right")
    out = set()
    for i in places.tolist():
        if 0 < i < len(sample):
            (a, _, _), (key, conv, _) = sample[i - 1], sample[i]
            shared = common_turns(a, key) + 1
            out.add((key[:TURN * shared], _FIRST) if a != key and TURN * shared < len(key) else (key, conv))
    return sorted(out)


def _route(ends: list[tuple[bytes, int]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(ends, x) for x in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], schema=schema)
    return run


# --- a shard ------------------------------------------------------------------

NODE = 0  # a finished node
PART = 1  # one shard's part of a skeleton node
LIST = 2  # ids of conversations that end at a skeleton node
_FOUND = ("kind int, id binary, parent_id binary, conv_id long, parent_conv_id long, depth long, words long, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, ends_sha256 string, place int, ends string")


class _Trie:
    """The trie of one shard's sorted paths; nodes stand in the order of their
    first members, so a parent stands before its children."""

    def __init__(self, left: bytes | None, right: bytes | None):
        self.bounds = [b for b in (left, right) if b is not None]
        self.depth, self.parent, self.words, self.ends, self.low, self.sha, self.ids, self.lists = [], [], [], [], [], [], [], {}
        self.stack: list[int] = []
        self.key = b""
        self.hasher = None
        self._new(0, -1, 0, bool(self.bounds), b"")

    def _new(self, depth: int, parent: int, words: int, shared: bool, turn: bytes) -> None:
        node = len(self.depth)
        self.depth.append(depth)
        self.parent.append(parent)
        self.words.append(words)
        self.ends.append(0)
        self.low.append(None)
        self.sha.append(_EMPTY_SHA)
        # A skeleton node is known by its parent's id and its last turn.
        self.ids.append(hashlib.blake2b((self.ids[parent] if parent >= 0 else b"") + turn, digest_size=16).digest() if shared else None)
        self.stack.append(node)

    def add(self, key: bytes, conv: int, words: list[int]) -> None:
        if key != self.key or self.hasher is None:
            self._ended()
            shared = common_turns(self.key, key)
            del self.stack[shared + 1:]
            spine = max((common_turns(key, b) for b in self.bounds), default=-1)
            for d in range(shared, len(key) // TURN):
                self._new(d + 1, self.stack[-1], words[d], d + 1 <= spine, key[TURN * d:TURN * (d + 1)])
            self.key, self.hasher = key, hashlib.sha256()
        node = self.stack[-1]
        if self.ids[node] is not None:
            self.lists.setdefault(node, []).append(conv)
        else:
            self.hasher.update(b",%d" % conv if self.ends[node] else b"%d" % conv)
        if not self.ends[node]:
            self.low[node] = conv
        self.ends[node] += 1

    def _ended(self) -> None:
        if self.hasher is not None:
            self.sha[self.stack[-1]] = self.hasher.hexdigest()

    def rows(self, shard: int) -> Iterator[tuple]:
        self._ended()
        n, low = list(self.ends), list(self.low)
        size = len(n)
        children, leaves, saved = [0] * size, [0] * size, [0] * size
        for i in range(size - 1, -1, -1):
            own = self.ids[i] is None
            if own:
                leaves[i] += children[i] == 0
                saved[i] += (n[i] - 1) * self.words[i]
            p = self.parent[i]
            if p >= 0:
                n[p] += n[i]
                if low[p] is None or low[i] < low[p]:
                    low[p] = low[i]
                children[p] += own  # skeleton children are counted once, over all shards
                leaves[p] += leaves[i]
                saved[p] += saved[i]
        for i, p in enumerate(self.parent):
            own, up = self.ids[i] is None, self.ids[p] if p >= 0 else None
            yield (NODE if own else PART, self.ids[i], up, low[i], low[p] if own and p >= 0 and up is None else None, self.depth[i], self.words[i],
                   n[i], children[i], leaves[i], saved[i], self.sha[i] if own else None, None, None)
        for i, convs in self.lists.items():
            for at in range(0, len(convs), ENDS):
                yield (LIST, self.ids[i], *[None] * 10, shard, ",".join(map(str, convs[at:at + ENDS])))


def _build(ends: list[tuple[bytes, int]], schema: pa.Schema):
    bounds = [None, *[key for key, _ in ends], None]

    def tables(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in rows:
            held.append(row)
            if len(held) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trie = None, None
        for batch in batches:
            for shard, key, conv, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "conv_id", "words"))):
                if shard != at:
                    if trie is not None:
                        yield from tables(trie.rows(at))
                    at, trie = shard, _Trie(bounds[shard], bounds[shard + 1])
                trie.add(key, conv, words)
        if trie is not None:
            yield from tables(trie.rows(at))
    return run


# --- the skeleton -------------------------------------------------------------


def _listed(schema: pa.Schema):
    """Sorted parts of the lists of ids -> the SHA-256 of each whole list, as a stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = hasher = None
        for batch in batches:
            ids, shas = [], []
            for key, ends in zip(batch.column("id").to_pylist(), batch.column("ends").to_pylist()):
                if key != node:
                    if node is not None:
                        ids.append(node)
                        shas.append(hasher.hexdigest())
                    node, hasher = key, hashlib.sha256(ends.encode())
                else:
                    hasher.update(b"," + ends.encode())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(shas)], schema=schema)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([hasher.hexdigest()])], schema=schema)
    return run


def _below(skeleton: DataFrame, depth: int) -> DataFrame:
    """(id, n_leaves, saved_tokens): sums of ``leaf`` and ``own`` over each
    skeleton node's subtree of skeleton nodes, ``depth`` levels at most."""
    sums = skeleton.select("id", F.col("parent_id").alias("up"), F.col("leaf").alias("n_leaves"), F.col("own").alias("saved_tokens"))
    reach = 1
    while reach <= depth:
        lifted = sums.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("id")).agg(F.sum("n_leaves").alias("__l"), F.sum("saved_tokens").alias("__s"))
        higher = sums.select(F.col("id").alias("up"), F.col("up").alias("__up"))
        met = sums.join(lifted, "id", "left").join(higher, "up", "left")
        sums = written(met.select("id", F.col("__up").alias("up"), (F.col("n_leaves") + F.coalesce("__l", F.lit(0))).alias("n_leaves"),
                                  (F.col("saved_tokens") + F.coalesce("__s", F.lit(0))).alias("saved_tokens")), "below")
        reach *= 2
    return sums.drop("up")


OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(stored: DataFrame, shards: int | None = None) -> DataFrame:
    """Nodes of the trie of ``stored`` paths (conv_id, key, words): the
    smallest member's id, depth, the parent's id, members, children, childless
    nodes below, words that repeats of a node's last turn would save (summed
    over its subtree) and the SHA-256 of the list of members that end there."""
    spark = stored.sparkSession
    ship(spark)
    ends = splitters(stored, shards)
    routed = T.StructType([T.StructField("shard", T.IntegerType()), *stored.schema])
    dealt = stored.mapInArrow(_route(ends, to_arrow_schema(routed)), routed).repartition("shard").sortWithinPartitions("shard", "key", "conv_id")
    schema = T.StructType.fromDDL(_FOUND)
    found = written(dealt.mapInArrow(_build(ends, to_arrow_schema(schema)), schema), "nodes")
    done = found.where(F.col("kind") == NODE)
    if not ends:
        return done.select(*OUT)

    parts = found.where(F.col("kind") == PART).groupBy("id").agg(
        F.any_value("parent_id").alias("parent_id"), F.any_value("depth").alias("depth"), F.any_value("words").alias("words"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    parts = written(parts, "skeleton")
    more = parts.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("__more"))
    n_children = F.col("n_children") + F.coalesce("__more", F.lit(0))
    parts = parts.join(more, "id", "left").withColumn("n_children", n_children)
    parts = written(parts.withColumns({"leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "own": (F.col("n_convs") - 1) * F.col("words")}), "skeleton")

    sizes = [len(key) // TURN for key, _ in ends]
    below = _below(parts, max(sizes)).select("id", F.col("n_leaves").alias("__l"), F.col("saved_tokens").alias("__s"))
    sha = T.StructType.fromDDL("id binary, ends_sha256 string")
    lists = found.where(F.col("kind") == LIST).withColumn("__first", F.substring_index("ends", ",", 1).cast("long"))
    lists = lists.select("id", "place", "__first", "ends").repartition("id").sortWithinPartitions("id", "place", "__first").select("id", "ends")
    lists = lists.mapInArrow(_listed(to_arrow_schema(sha)), sha)
    known = parts.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("__up"))
    known = F.broadcast(known) if sum(sizes) <= BROADCAST_NODES else known  # the skeleton has no more nodes than the splitters have turns, and a root
    spine = parts.join(below, "id").join(lists, "id", "left").withColumns({
        "n_leaves": F.col("n_leaves") + F.col("__l"), "saved_tokens": F.col("saved_tokens") + F.col("__s"), "ends_sha256": F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)),
        "parent_conv_id": F.lit(None).cast("long")})
    nodes = done.select(*OUT, "parent_id").unionByName(spine.select(*OUT, "parent_id"))
    return nodes.join(known, "parent_id", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__up")).select(*OUT)


def op13_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(conversations(read(spark, sf_dir, "conversations")), "conversations")
    return prefix_trie(written(paths(rebuilt(own)), "paths"))


#: crc32 of an ASCII string: each byte goes in with eight shifts.
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for c in string_split({0}, '')])), "
        "lambda a, b: xor(xor(a, b) // 2, 3988292384 * (xor(a, b) % 2))), 4294967295::BIGINT)")

OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, role, text, md5(length(role) || ':' || role || text) AS k,
         len(regexp_extract_all(text, '{WORD}')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT c, {_CRC.format("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id AS c FROM t)),
turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, k, w FROM (
    SELECT c, 0 AS own, pos, k, w FROM convs JOIN t ON t.conv_id = c - c % 20 AND pos <= h
    UNION ALL SELECT c, 1, pos, k, w FROM convs JOIN t ON t.conv_id = c AND pos > h)),
paths AS (SELECT c, coalesce(p, []) AS p FROM convs LEFT JOIN (SELECT c, list(k ORDER BY d) AS p FROM turns GROUP BY c) USING (c)),
members AS (
  SELECT c, d, len(p) AS size, md5(array_to_string(p[1:d], '')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(p[1:d - 1], '')) END AS up
  FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM paths)),
nodes AS (
  SELECT node, any_value(up) AS up, d AS depth, min(m.c) AS conv_id, count(*) AS n_convs, coalesce(max(w), 0) AS w,
         string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (size = d) AS ends
  FROM members m LEFT JOIN turns USING (c, d) GROUP BY node, d),
kids AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
told AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (node)),
sums AS (
  SELECT m.node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
  FROM told n JOIN members m ON m.c = n.conv_id AND m.d <= n.depth GROUP BY m.node)
SELECT t.conv_id, t.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(t.ends, '')) AS ends_sha256
FROM told t JOIN sums s USING (node) LEFT JOIN nodes u ON u.node = t.up
"""
