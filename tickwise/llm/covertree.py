"""Exact top-k by inner product with dual cover trees (operator 1).

Rows are dealt to the nearest of a few pivots (the top level of the tree,
chosen far apart on a bounded sample) and, within a pivot's cell, to blocks of
bounded size. A task builds a cover tree over its block: the children of a
node are centres that lie farther apart than the radius that each covers, down
to small leaves. Queries are indexed in the same way, in blocks of their own.

Every query starts with its kth score within the sample, a lower bound of the
final one. Query blocks meet only cells, and within a block pair query nodes
meet only data nodes, where the bound reaches the worst kth score of the query
node; otherwise the pair of nodes is pruned; below a leaf of queries each query has a
bound of its own. For centres q, p with radii r, s the
bound is the lower of <q, p> + r|p| + s|q| + rs and, with X and Y the greatest
lengths of both nodes' vectors, (X^2 + Y^2 - max(0, |q - p| - r - s)^2) / 2. The
search goes in two rounds: a query block first meets one data block of each of
its few nearest cells, which raises its kth scores, and then the rest of what
those still let through. Scores are integers and exact.

Cases: rows with a null id, a null vector or a null or non-finite component
take no part; vectors meet vectors of their own length only; rows repeated
with id and vector count once; of equal vectors the smaller ids come first; a
query never finds rows of its own id; queries with fewer candidates get all;
components beyond the doubles after scaling and scores beyond a long are held
at their limits; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm.common import read, ship, written
from tickwise.llm.vectors import best, by_dim, fewest, sample, usable

K = 20
SAMPLE = 4096  # rows for pivots and first bounds
CELLS = 64  # pivots at most
BLOCK = 8192  # rows of a block, about
QUERY_BLOCK = 2048
FAN = 16  # children of a node
LEAF = 128
NEAR = 4  # cells of the first round
_LONG = np.iinfo(np.int64)


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(64 * x); doubles hold it exactly."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(64.0 * x), -np.finfo(np.float64).max, np.finfo(np.float64).max)


def _small(x: np.ndarray) -> np.ndarray:
    """The same values in as few bytes as hold them."""
    top = np.abs(x).max(initial=0)
    return x.astype(np.int16) if top < 1 << 15 else x.astype(np.int32) if top < 1 << 31 else x


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class Tree:
    """Cover tree over the rows of a matrix; a node covers ``rows[lo:hi]``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        order = np.arange(len(x))
        self.lo, self.hi, self.center, self.radius, self.children = [], [], [], [], []
        todo = [(0, len(x), 0, None)]
        while todo:
            lo, hi, center, parent = todo.pop()
            rows = order[lo:hi].copy()
            own = x[rows]
            near = _distances(own, x[center])
            node = len(self.lo)
            for column, value in ((self.lo, lo), (self.hi, hi), (self.center, center), (self.radius, float(near.max(initial=0))), (self.children, [])):
                column.append(value)
            if parent is not None:
                self.children[parent].append(node)
            if hi - lo <= leaf or near.max(initial=0) == 0:
                continue
            centers, of = [center], np.zeros(hi - lo, np.int64)
            most = min(fan, -(-2 * (hi - lo) // leaf))  # leaves of half the size on average, not of a few rows
            while len(centers) < most and near.max() > 0:  # the farthest point: apart from all by what is still uncovered
                far = int(near.argmax())
                d = _distances(own, own[far])
                closer = d < near
                of[closer], near[closer] = len(centers), d[closer]
                centers.append(int(rows[far]))
            by_center = np.argsort(of, kind="stable")
            order[lo:hi] = rows[by_center]
            cuts = lo + np.searchsorted(of[by_center], np.arange(len(centers) + 1))
            todo += [(int(a), int(b), c, node) for a, b, c in zip(cuts[:-1], cuts[1:], centers)]
        self.rows = order
        self.centers = x[self.center]
        self.norms = _lengths(self.centers)
        self.radii = np.array(self.radius) * (1 + 1e-9)
        lengths = _lengths(x[order])
        self.tops = np.array([lengths[lo:hi].max(initial=0) for lo, hi in zip(self.lo, self.hi)])


def _lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(np.einsum("ij,ij->i", x, x))


def _limit(inner, q, r, p, s, x, y):
    """Highest inner product of vectors within r of a centre of length q and
    within s of one of length p, none longer than x and y; a little above."""
    with np.errstate(over="ignore", invalid="ignore"):
        plain = inner + r * p + q * s + r * s
        apart = np.maximum(0, np.sqrt(np.maximum(0, q * q + p * p - 2 * inner)) - r - s)
        # Differences of large squares: what they may be off by goes on top.
        far = (x * x + y * y - apart * apart) / 2 + 1e-9 * (x * x + y * y + q * q + p * p)
        b = np.fmin(plain, np.where(np.isfinite(far), far, np.inf))
    return b + 1e-6 * np.maximum(1, np.abs(b))


def _bounds(q: Tree, r: Tree, qs: list[int], rs: list[int]) -> np.ndarray:
    return _limit(q.centers[qs] @ r.centers[rs].T, q.norms[qs][:, None], q.radii[qs][:, None], r.norms[rs][None, :], r.radii[rs][None, :],
                  q.tops[qs][:, None], r.tops[rs][None, :])


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return a @ b.T
    out = [[sum(int(s) * int(t) for s, t in zip(x, y)) for y in b] for x in a]
    return np.array([[min(max(v, _LONG.min + 1), _LONG.max) for v in row] for row in out], np.int64).reshape(len(a), len(b))


def search(q: Tree, qx: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, r: Tree, rx: np.ndarray, r_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k of the block for every query: (ids, scores), both by row of qx;
    free places have the id ``_LONG.max``. Scores below ``floor`` don't matter."""
    exact = np.abs(qx).max(initial=0) * np.abs(rx).max(initial=0) * max(1, qx.shape[1]) < 1 << 53
    qo, ro = qx[q.rows], rx[r.rows]
    q_id, r_id = q_ids[q.rows], r_ids[r.rows]
    lengths = _lengths(qo)
    top = np.full((len(qo), k), _LONG.min)
    who = np.full((len(qo), k), _LONG.max)
    worst = floor[q.rows].copy()
    todo = [(0, 0, float("inf"))]
    while todo:
        a, b, bound = todo.pop()
        rows = slice(q.lo[a], q.hi[a])
        if bound < worst[rows].min(initial=_LONG.max):
            continue
        qs, rs = q.children[a], r.children[b] or [b]
        if qs:
            bounds = _bounds(q, r, qs, rs)
            flat = np.argsort(bounds, axis=None)  # the best last, so it is popped first
            todo += [(qs[i // len(rs)], rs[i % len(rs)], float(bounds.flat[i])) for i in flat.tolist()]
            continue
        # Queries of a leaf each have a bound of their own, without the leaf's radius.
        each = _limit(qo[rows] @ r.centers[rs].T, lengths[rows][:, None], 0.0, r.norms[rs][None, :], r.radii[rs][None, :], lengths[rows][:, None], r.tops[rs][None, :])
        each[each < worst[rows][:, None]] = -np.inf
        if r.children[b]:
            top_of = each.max(axis=0)
            todo += [(a, rs[i], float(top_of[i])) for i in np.argsort(top_of).tolist() if top_of[i] > -np.inf]
            continue
        some = np.flatnonzero(each[:, 0] > -np.inf)
        if not len(some):
            continue
        s = _products(qo[some + q.lo[a]], ro[r.lo[b]:r.hi[b]], exact)
        reach = (s >= worst[some + q.lo[a]][:, None]).any(axis=1)
        hit, s = some[reach], s[reach]
        if not len(hit):
            continue
        at = hit + q.lo[a]
        ids = np.broadcast_to(r_id[r.lo[b]:r.hi[b]], (len(hit), r.hi[b] - r.lo[b]))
        own = ids == q_id[at][:, None]
        s = np.where(own, _LONG.min, s.astype(np.int64))
        ids = np.where(own, _LONG.max, ids)
        s, ids = np.concatenate([top[at], s], 1), np.concatenate([who[at], ids], 1)
        order = np.lexsort((ids, ~s), axis=1)[:, :k]
        top[at], who[at] = np.take_along_axis(s, order, 1), np.take_along_axis(ids, order, 1)
        worst[at] = np.maximum(worst[at], top[at][:, -1])
    back = np.empty_like(q.rows)
    back[q.rows] = np.arange(len(q.rows))
    return who[back], top[back]


def _pivots(x: np.ndarray, n: int) -> np.ndarray:
    chosen = [0]
    near = _distances(x, x[0])
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[chosen[-1]]))
    return x[chosen]


ROW = "dim int, cell int, id long, far double, top double, floor long, x binary"


def _deal(shared, k: int, queries: bool):
    """Rows -> the cell of the nearest pivot; queries also get their kth score within the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in by_dim(batch):
                pivots, ids, known = shared.value.get(dim, (np.zeros((1, dim)), np.empty(0, np.int64), np.empty((0, dim))))
                x, own = scaled(x), batch.column("id").to_numpy()[at]
                d = np.stack([_distances(x, p) for p in pivots], 1)
                cell = d.argmin(axis=1)
                floor = np.full(len(x), _LONG.min)
                if queries and len(ids) > k and np.abs(x).max(initial=0) * np.abs(known).max(initial=0) * max(1, dim) < 1 << 53:
                    for i in range(0, len(x), 512):
                        s = x[i:i + 512] @ known.T
                        s[own[i:i + 512, None] == ids[None, :]] = -np.inf
                        kth = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
                        floor[i:i + 512] = np.where(np.isfinite(kth), kth, 0).astype(np.int64)
                        floor[i:i + 512][~np.isfinite(kth)] = _LONG.min
                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array([dim] * len(x), pa.int32()), "cell": pa.array(cell.astype(np.int32)), "id": pa.array(own), "far": pa.array(d[np.arange(len(x)), cell]), "top": pa.array(_lengths(x)),
                    "floor": pa.array(floor), "x": pa.array([row.tobytes() for row in x], pa.binary())})
    return run


BLOCKS = "dim int, cell int, sub int, block binary"


def _index(k: int, queries: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float64).reshape(table.num_rows, dim)
        ids, floor = table.column("id").to_numpy(), table.column("floor").to_numpy()
        if not queries:
            keep = fewest(ids, x, k + 1)
            ids, x, floor = ids[keep], x[keep], floor[keep]
        tree = Tree(x, leaf=LEAF // 2 if queries else LEAF)
        block = pickle.dumps((tree, _small(x), ids, floor))
        return pa.Table.from_pydict({"dim": pa.array([dim], pa.int32()), "cell": pa.array([key[1].as_py()], pa.int32()),
                                     "sub": pa.array([key[2].as_py()], pa.int32()), "block": pa.array([block], pa.binary())})
    return run


TARGETS = "dim int, cell int, sub int, at_cell int, at_sub int, asked binary"


def _targets(shared, cells: dict, first: bool):
    """Query blocks -> a row for each data block to meet. First round: a block
    of each of the nearest cells; second round: all others whose cell the bound
    doesn't exclude, with the kth scores that the first one gave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, own_cells, subs_of, packed = (batch.column(c).to_pylist() for c in ("dim", "cell", "sub", "block"))
            raised = [None] * len(dims) if first else batch.column("raised").to_pylist()
            for dim, own_cell, own_sub, block, higher in zip(dims, own_cells, subs_of, packed, raised):
                tree, x, ids, floor = pickle.loads(block)
                if higher:
                    floor = floor.copy()
                    np.maximum.at(floor, [h["place"] for h in higher], [h["kth"] for h in higher])
                    block = pickle.dumps((tree, x, ids, floor))
                pivots = shared.value[dim][0] if dim in shared.value else np.zeros((1, dim))
                here = cells.get(dim, {})
                inner = {cell: float(tree.centers[0] @ pivots[cell]) for cell in here}
                met = {(cell, own_sub % here[cell][0]) for cell in sorted(here, key=lambda c: (-inner[c], c))[:NEAR]}
                go = sorted(met) if first else []
                for cell, (subs, far, top) in ({} if first else here).items():
                    if _limit(inner[cell], tree.norms[0], tree.radii[0], float(_lengths(pivots[cell][None, :])[0]), far * (1 + 1e-9), tree.tops[0], top) >= floor.min(initial=_LONG.max):
                        go += [(cell, sub) for sub in range(subs) if (cell, sub) not in met]
                for i in range(0, len(go), 64):
                    part = go[i:i + 64]
                    yield pa.RecordBatch.from_pydict({
                        **{c: pa.array(v, pa.int32()) for c, v in (("dim", [dim] * len(part)), ("cell", [c for c, _ in part]), ("sub", [s for _, s in part]),
                                                                  ("at_cell", [own_cell] * len(part)), ("at_sub", [own_sub] * len(part)))},
                        "asked": pa.array([block] * len(part), pa.binary())})
    return run


FOUND = "dim int, at_cell int, at_sub int, place int, query_id long, print long, vec_id long, score long"


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (asked, block) in enumerate(zip(batch.column("asked"), batch.column("block"))):
                q, qx, q_ids, floor = pickle.loads(asked.as_py())
                r, rx, r_ids, _ = pickle.loads(block.as_py())
                qx, rx = qx.astype(np.float64), rx.astype(np.float64)
                ids, scores = search(q, qx, q_ids, floor, r, rx, r_ids, k)
                rows, places = np.nonzero(ids != _LONG.max)
                whose = {c: pa.array(np.full(len(rows), batch.column(c)[i].as_py(), np.int32)) for c in ("dim", "at_cell", "at_sub")}
                yield pa.RecordBatch.from_pydict({**whose, "place": pa.array(rows.astype(np.int32)), "query_id": pa.array(q_ids[rows]), "print": pa.array(_print(qx)[rows]),
                                                  "vec_id": pa.array(ids[rows, places]), "score": pa.array(scores[rows, places])})
    return run


def _print(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row."""
    bits = np.ascontiguousarray(x).view(np.uint64)
    odd = np.arange(1, 2 * x.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    mixed = (bits ^ (bits >> np.uint64(29))) * odd
    return ((mixed ^ (mixed >> np.uint64(32))).sum(axis=1, dtype=np.uint64)).view(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of ``vectors`` with the
    highest integer inner product for each row of ``queries``."""
    spark = vectors.sparkSession
    ship(spark)
    rows, asked = usable(vectors, id_column, vector_column), usable(queries, id_column, vector_column)
    total = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    known = {dim: (_pivots(scaled(x), max(1, min(CELLS, -(-total[dim] // BLOCK)))), ids, scaled(x)) for dim, (ids, x) in sample(rows, SAMPLE).items()}
    shared = spark.sparkContext.broadcast(known)  # SAMPLE vectors

    def blocks(side: DataFrame, size: int, name: str, is_query: bool):
        dealt = written(side.mapInArrow(_deal(shared, k, is_query), ROW), name)
        counts = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("top").alias("top")).collect()  # CELLS rows a dim
        cells: dict[int, dict[int, tuple[int, float, float]]] = {}
        for c in counts:
            cells.setdefault(c["dim"], {})[c["cell"]] = (-(-c["n"] // size), c["far"], c["top"])
        sizes = spark.createDataFrame([(d, c, n) for d, of in cells.items() for c, (n, _, _) in of.items()], "dim int, cell int, subs int")
        # By id and vector: an id with a large share of the rows is dealt over blocks too.
        numbered = dealt.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id", "x"), "subs").cast("int")).drop("subs", "far", "top")
        return written(numbered.groupBy("dim", "cell", "sub").applyInArrow(_index(k, is_query), BLOCKS), f"{name}-blocks"), cells

    data, cells = blocks(rows, BLOCK, "vectors", False)
    wanted, _ = blocks(asked.dropDuplicates(["id", "vector"]), QUERY_BLOCK, "queries", True)

    def met(blocks_asked: DataFrame, first: bool) -> DataFrame:
        pairs = blocks_asked.mapInArrow(_targets(shared, cells, first), TARGETS).join(data, ["dim", "cell", "sub"])
        return pairs.mapInArrow(_search(k), FOUND)

    near = written(met(wanted, True), "near")
    # At most NEAR * k scores a query, QUERY_BLOCK queries a block or so.
    kth = (near.groupBy("dim", "at_cell", "at_sub", "place").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores")).where(F.size("scores") >= k)
           .select("dim", F.col("at_cell").alias("cell"), F.col("at_sub").alias("sub"), F.struct("place", F.element_at("scores", k).alias("kth")).alias("one")))
    raised = kth.groupBy("dim", "cell", "sub").agg(F.collect_list("one").alias("raised"))
    rest = met(wanted.join(raised, ["dim", "cell", "sub"], "left"), False)
    return best(near.unionByName(rest).select("query_id", "print", "vec_id", "score"), k)


def op1_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


OP1_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.z, r.vec_id, list_inner_product(q.z, r.z)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id AND len(q.z) = len(r.z))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, z ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
