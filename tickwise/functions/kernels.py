"""Window kernels over partitioned time series.

Every kernel works on *all* series at once: a series is the rows sharing
``keys`` (``symbol`` for the bars table, a request's parameter set in batch
evaluation), ordered by ``order``. Frames count rows, never calendar days
(V4), and all rolling frames use "min 1 row" semantics (V3), which Spark's
frame aggregates have natively.

``in_blocks`` cuts long series into blocks of consecutive rows, so that one
series spans as many tasks as it has blocks: positions come from counts per
(series, year) and a running sum over those few counts; each block gets the
last rows of the block before as a halo, which rolling frames read and
``out_of_blocks`` drops again. Windows partitioned by ``keys + BLOCK`` are then
exact. Series that are known to be short (one request's range) can stay whole:
``in_one_pass`` numbers them with a window and marks the same blocks.
"""

from __future__ import annotations

import math
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

BLOCK_ROWS = 512  # q^-r stays below e^562 within a block for any span from 2
BLOCK, POSITION, HALO, SEEN = "__blk", "__i", "__halo", "__seen"
MARKS = (BLOCK, POSITION, HALO, SEEN)
SERIES = "__series"  # hash of the keys: never null, so a plain join by it stays where the rows are


def _list(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def series_window(keys=("symbol",), order="date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*_list(order))


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The last ``n`` rows including the current one."""
    if n < 1:
        raise ValueError("window length must be >= 1")
    return w.rowsBetween(-(n - 1), Window.currentRow)


def rolling_mean(col: Column | str, n: int, w: WindowSpec) -> Column:
    """Mean of the last n rows (nulls skipped, min one row)."""
    return F.avg(col).over(trailing(w, n))


def rolling_std(col: Column | str, n: int, w: WindowSpec) -> Column:
    """Sample deviation (ddof=1) of the last n rows; NULL for one row."""
    return F.stddev_samp(col).over(trailing(w, n))


def first_difference(col: Column | str, w: WindowSpec) -> Column:
    """x[t] - x[t-1]; NULL on the first row of each series."""
    c = F.col(col) if isinstance(col, str) else col
    return c - F.lag(c, 1).over(w)


def gain(diff: Column) -> Column:
    """Positive part of a difference; NULL differences count as 0 (V8)."""
    return F.when(diff > 0, diff).otherwise(F.lit(0.0))


def loss(diff: Column) -> Column:
    """Negated negative part of a difference; NULL counts as 0 (V8)."""
    return F.when(diff < 0, -diff).otherwise(F.lit(0.0))


def _alike(a: Column, b: Column) -> Column:
    """Equal or both null, as a check beside the keys of a join: null-safe keys
    would be hashed in another way than the rows lie and move them again."""
    return F.coalesce(a == b, a.isNull() & b.isNull())


# --- blocks -------------------------------------------------------------------


def in_blocks(df: DataFrame, col: str = "close", keys=("symbol",), order="date", halo: int = 0,
              cut: Column | None = None, dealt: bool = True) -> DataFrame:
    """Cut every series into blocks of ``BLOCK_ROWS`` rows (more if the halo
    needs it), each with the ``halo`` rows before it.

    ``order`` may list tie-break columns after the date: rows that are equal in
    all of them have no defined order (V16). ``cut`` is a coarse, monotone
    function of the first order column (default: its year); rows are only ever
    numbered within one (series, cut), whose counts are summed up per series.
    ``dealt``: whether the blocks are dealt out to tasks here.
    """
    keys, order = _list(keys), _list(order)
    size = max(BLOCK_ROWS, -(-halo // BLOCK_ROWS) * BLOCK_ROWS)
    df = df.withColumn("__cut", F.year(order[0]) if cut is None else cut)
    df = df.withColumn("__part", F.xxhash64(*keys, "__cut"))
    counts = df.groupBy("__part", *keys, "__cut").agg(F.count(F.lit(1)).alias("__n"), F.count(col).alias("__c"))
    ahead = Window.partitionBy(*keys).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{j}") for j, k in enumerate([*keys, "__cut"])],
                            F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__n0"),
                            F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__c0"))
    within = Window.partitionBy("__part", *keys, "__cut").orderBy(*order)
    df = df.repartition("__part").withColumns({POSITION: F.row_number().over(within) - 1,
                                               SEEN: F.count(col).over(within.rowsBetween(Window.unboundedPreceding, 0))})
    on = reduce(lambda x, y: x & y, [df["__part"] == offsets["__p"], *[_alike(df[k], offsets[f"__k{j}"]) for j, k in enumerate([*keys, "__cut"])]])
    df = (df.join(offsets, on).withColumns({POSITION: F.col(POSITION) + F.col("__n0"), SEEN: F.col(SEEN) + F.col("__c0")})
          .drop("__part", "__p", "__cut", "__n0", "__c0", *[f"__k{j}" for j in range(len(keys) + 1)]))
    own = F.floor(F.col(POSITION) / F.lit(size))
    if halo:
        is_tail = F.col(POSITION) % size >= size - halo
        homes = F.when(is_tail, F.array(own, own + 1)).otherwise(F.array(own))
        df = df.withColumn(BLOCK, F.explode(homes)).withColumn(HALO, F.col(BLOCK) > own)
    else:
        df = df.withColumns({BLOCK: own, HALO: F.lit(False)})
    df = with_series(df, keys)
    return df.repartition(SERIES, BLOCK) if dealt else df


def in_one_pass(df: DataFrame, col: str = "close", keys=("symbol",), order="date") -> DataFrame:
    """The marks of ``in_blocks`` for series that fit one task; windows stay
    partitioned by ``keys`` alone."""
    w = series_window(keys, order)
    return df.withColumns({
        POSITION: F.row_number().over(w) - 1,
        SEEN: F.count(col).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    }).withColumns({BLOCK: F.floor(F.col(POSITION) / F.lit(BLOCK_ROWS)), HALO: F.lit(False), SERIES: F.xxhash64(*keys)})


def is_marked(df: DataFrame) -> bool:
    """Whether ``df`` has the marks already (a table of stored blocks)."""
    return set(MARKS) <= set(df.columns)


def stored_halo(df: DataFrame) -> int | None:
    """Rows that each stored block brings along from the one before; None for
    marks that were made in this plan."""
    return df.schema[HALO].metadata.get("rows")


def block_window(keys=("symbol",)) -> WindowSpec:
    """Order of the rows of one block, halo first."""
    return Window.partitionBy(*keys, SERIES, BLOCK).orderBy(POSITION)


def with_series(df: DataFrame, keys=("symbol",)) -> DataFrame:
    return df if SERIES in df.columns else df.withColumn(SERIES, F.xxhash64(*keys))


def out_of_blocks(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(*[c for c in df.columns if c in (*MARKS, SERIES)])


# --- exponential mean -------------------------------------------------------
#
# e[0] = x[0];  e[t] = a*x[t] + q*e[t-1],  a = 2/(span+1), q = 1-a   (V5)
#
# Spark has no recursive window function. Within a block, with r the number
# of the value in the block (from 0) and w = 1 for the seed, a otherwise,
#   R = running sum of w x q^-r,      e = q^r R + q^(r+1) P,
# where P is the mean at the end of the block before. With M the values up to
# the end of a block and S = q^(m-1) R at its end (m values in the block),
#   P = sum over earlier blocks j of S_j q^(M_before - M_j):
# a frame over one row per block, as far back as q^distance times the largest
# double is not zero. Nothing older can be told from zero in double precision,
# so the recurrence is kept down to underflow, over any number of blocks.

_REACH = math.log(sys.float_info.max) - math.log(5e-324)


def _reach(span: int) -> int:
    """Values after which even the largest double has decayed to zero."""
    return math.ceil(_REACH / -math.log(1.0 - 2.0 / (span + 1.0)))


def ewm_means(df: DataFrame, specs, keys=("symbol",), state: DataFrame | None = None, order="date", beside=()) -> DataFrame:
    """Add one exponential-mean column per ``(source, span, out)`` spec to
    a frame with the marks of ``in_blocks`` or ``in_one_pass``. ``state``
    (keys and a column for each ``out``): the means that series have reached
    before these rows; a series without one starts with its first value.

    The rows are read twice, for the ends of their blocks and for themselves. The
    ends take ``order`` and the columns ``beside`` along, so that both reads want
    the same columns and the rows are shuffled once (Spark reuses the exchange).

    All sources must share the null pattern of the marked column; null rows get
    a NULL result and do not break the recurrence (V15: the mean runs over the
    non-null values). NaN and overflow stay with all later values, as in the
    recurrence.
    """
    keys, specs = _list(keys), list(specs)
    for _, span, _ in specs:
        if span < 1:
            raise ValueError("span must be >= 1")
    smooth = [s for s in specs if s[1] > 1]
    final = {out: F.when(~F.col(HALO), F.col(src)) for src, span, out in specs if span == 1}  # a = 1: the value itself
    if not smooth:
        return df.withColumns(final)
    running = block_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    here = F.col(smooth[0][0]).isNotNull() & ~F.col(HALO)
    reached = {out: f"__{out}_0" for _, _, out in smooth}
    if state is not None:
        known = state.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], *[F.col(out).alias(c) for out, c in reached.items()])
        df = df.join(known, reduce(lambda x, y: x & y, [df[k].eqNullSafe(known[f"__k{j}"]) for j, k in enumerate(keys)]), "left").drop(*[f"__k{j}" for j in range(len(keys))])
    df = with_series(df, keys).withColumn("__r", F.count(F.when(here, 1)).over(running) - 1)
    r = F.col("__r")
    terms = {}
    for src, span, out in smooth:
        a = 2.0 / (span + 1.0)
        seed = (F.col(SEEN) == 1) if state is None else (F.col(SEEN) == 1) & F.col(reached[out]).isNull()
        weight = F.when(seed, F.lit(1.0)).otherwise(F.lit(a))
        terms[f"__{out}_t"] = F.when(here, weight * F.col(src) * F.pow(F.lit(1.0 - a), -r))
    df = df.withColumns(terms)
    simple = {f.name for f in df.schema if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)}  # a largest value exists
    last = {f"__last{j}": F.max(c) for j, c in enumerate(c for c in dict.fromkeys([*_list(order), *beside]) if c in simple)}
    ends = df.where(here).groupBy(*keys, SERIES, BLOCK).agg(
        F.max(SEEN).alias("__upto"), *[m.alias(n) for n, m in last.items()], F.count(F.lit(1)).alias("__c"), *[F.sum(f"__{out}_t").alias(f"__{out}_s") for _, _, out in smooth])
    carried, sticky = {}, {}
    for _, span, out in smooth:
        q = 1.0 - 2.0 / (span + 1.0)
        s = F.pow(F.lit(q), F.col("__c") - 1) * F.col(f"__{out}_s")
        # Frames look at the values seen before this block (__B): by distance, whatever the blocks hold.
        near = Window.partitionBy(*keys).orderBy("__upto").rangeBetween(-(_reach(span) + BLOCK_ROWS), -1)
        ahead = Window.partitionBy(*keys).orderBy("__upto", *last).rowsBetween(Window.unboundedPreceding, -1)
        carried[f"__{out}_l"] = F.collect_list(F.struct(F.col("__upto").alias("M"), s.alias("s"))).over(near)
        sticky[f"__{out}_v"] = F.sum(F.when(F.isnan(s) | (F.abs(s) == float("inf")), s)).over(ahead)
    ends = ends.withColumns({**carried, **sticky}).withColumn("__B", F.col("__upto") - F.col("__c"))
    previous = {}
    for _, span, out in smooth:
        q = F.lit(1.0 - 2.0 / (span + 1.0))
        # Horner over the blocks, oldest first: P = (..(s1 q^(M2-M1) + s2) q^(M3-M2) ..) with the last step to __B.
        total = F.aggregate(f"__{out}_l", F.struct(F.lit(0).cast("long").alias("M"), F.lit(0.0).alias("s")),
                            lambda acc, e: F.struct(e["M"].alias("M"), (acc["s"] * F.pow(q, e["M"] - acc["M"]) + e["s"]).alias("s")))
        previous[f"__{out}_p"] = F.coalesce(f"__{out}_v", total["s"])
    ends = ends.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], F.col(SERIES).alias("__s"), F.col(BLOCK).alias("__b"), *[v.alias(n) for n, v in previous.items()])
    # Stored blocks have no null keys: a plain equality keeps to their buckets.
    stored = stored_halo(df) is not None
    same = [df[k] == ends[f"__k{j}"] if stored else _alike(df[k], ends[f"__k{j}"]) for j, k in enumerate(keys)]
    on = reduce(lambda x, y: x & y, [*same, df[BLOCK] == ends["__b"], *([] if stored else [df[SERIES] == ends["__s"]])])
    df = df.join(ends, on, "left").drop("__s", "__b", *[f"__k{j}" for j in range(len(keys))])
    for src, span, out in smooth:
        q = F.lit(1.0 - 2.0 / (span + 1.0))
        run = F.sum(f"__{out}_t").over(running)
        first = F.col(SEEN) == r + 1  # no value before this block
        before = F.when(first, F.lit(0.0)).otherwise(F.pow(q, r + 1) * F.col(f"__{out}_p"))
        if state is not None:
            before = before + F.coalesce(F.pow(q, F.col(SEEN)) * F.col(reached[out]), F.lit(0.0))
        final[out] = F.when(here, F.pow(q, r) * run + before)
    df = df.withColumns(final)
    return df.drop("__r", *terms, *[f"__{out}_p" for _, _, out in smooth], *reached.values())


def ewm_state(df: DataFrame, outs, keys=("symbol",), order="date") -> DataFrame:
    """The last mean of each series, for ``ewm_means`` of the rows that follow."""
    last = [F.max_by(out, F.when(F.col(out).isNotNull(), F.struct(*_list(order)))).alias(out) for out in outs]
    return df.groupBy(*keys).agg(*last)
