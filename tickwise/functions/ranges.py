"""Indicators of many short ranges at once (O54), as NumPy over Arrow batches.

Spark has matched every range with its bars (``operators.rangeindex``); a row here
is one range with its dates, its closes and its own parameters. Ranges of about
the same length stand side by side in a matrix (a row each), so that

* a rolling mean or RSI sum is the difference of two running sums, whatever the
  window's length;
* a rolling deviation comes from sums of squares about the range's first close;
  where the subtraction would cost too many digits (``DIGITS``), from the
  window's values in two passes;
* an exponential mean is the recurrence itself, a step for all ranges at a time.

A step's memory is bounded by ``CELLS`` whatever a batch holds, up to one range.
Null closes are skipped, as in ``functions.kernels``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# The functions run in executor Python workers; ship them by value so the
# workers need only NumPy and Arrow, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 1 << 19  # numbers of a matrix
#: A sum of squares this many times a window's own loses too many digits.
DIGITS = 50.0
#: Columns that each indicator gives.
COLUMNS = {"sma": ("value",), "ema": ("value",), "rsi": ("value",), "macd": ("macd", "signal", "histogram"), "bollinger": ("upper", "middle", "lower")}


def _back(running: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What running values grew by over the last ``n`` rows (n: one a range)."""
    at = np.arange(running.shape[1]) - n[:, None]
    return running - np.where(at >= 0, np.take_along_axis(running, np.maximum(at, 0), 1), 0)


def _mean(x: np.ndarray, there: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the last ``n`` rows and how many closes they have."""
    total, count = _back(np.cumsum(x, 1), n), _back(np.cumsum(there, 1), n)
    return total / count, count


def _sma(x, there, p1, p2, p3, k):
    mean, count = _mean(x, there, p1)
    return [(mean, count > 0)]


def _rsi(x, there, p1, p2, p3, k):
    moves = np.zeros_like(x)
    moves[:, 1:] = np.where(there[:, 1:] & there[:, :-1], x[:, 1:] - x[:, :-1], 0)
    up, down = (_back(np.cumsum(np.maximum(m, 0), 1), p1) for m in (moves, -moves))
    return [(np.where(down > 0, 100.0 - 100.0 / (1.0 + up / down), 100.0), (down > 0) | (up > 0))]


def _bollinger(x, there, p1, p2, p3, k):
    mean, count = _mean(x, there, p1)
    rows = np.arange(len(x))
    moved = np.where(there, x - x[rows, there.argmax(1)][:, None], 0)
    y, running = _back(np.cumsum(moved, 1), p1), np.cumsum(moved * moved, 1)
    squares = _back(running, p1) - y * y / count
    r, i = np.nonzero((count > 1) & ~(running <= squares * DIGITS))
    again, middle = np.zeros(len(r)), mean[r, i]
    for back in range(min(int(p1.max()), x.shape[1]) - 1, -1, -1):
        some = np.flatnonzero((back < p1[r]) & (back <= i))
        rs, at = r[some], i[some] - back
        again[some] += np.where(there[rs, at], (x[rs, at] - middle[some]) ** 2, 0)
    squares[r, i] = again
    wide = k[:, None] * np.sqrt(squares / (count - 1))
    return [(mean + wide, count > 1), (mean, count > 0), (mean - wide, count > 1)]


def _scan(x: np.ndarray, there: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Exponential means down the columns of ``x`` (a column a range)."""
    a = 2.0 / (span + 1.0)
    q = 1.0 - a
    out, e, begun = np.empty_like(x), np.zeros(x.shape[1]), np.zeros(x.shape[1], bool)
    for t in range(len(x)):
        e = np.where(there[t], np.where(begun, a * x[t] + q * e, x[t]), e)
        begun |= there[t]
        out[t] = e
    return out


def _ema(x, there, p1, p2, p3, k):
    return [(_scan(np.ascontiguousarray(x.T), there.T.copy(), p1).T, there)]


def _macd(x, there, p1, p2, p3, k):
    down, seen = np.ascontiguousarray(x.T), there.T.copy()
    line = _scan(down, seen, p1) - _scan(down, seen, p2)
    signal = _scan(line, seen, p3)
    return [(line.T, there), (signal.T, there), ((line - signal).T, there)]


_OF = {"sma": _sma, "ema": _ema, "rsi": _rsi, "macd": _macd, "bollinger": _bollinger}


def _pieces(lengths: np.ndarray) -> Iterator[slice]:
    """Cuts rows so that a matrix of each piece has about ``CELLS`` numbers."""
    start = 0
    while start < len(lengths):
        room = CELLS // max(1, int(lengths[start]))
        widest = np.maximum.accumulate(lengths[start:start + max(1, room)])
        fits = int(np.count_nonzero(widest * np.arange(1, len(widest) + 1) <= CELLS))
        yield slice(start, start + max(1, fits))
        start += max(1, fits)


def _number(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, 1).to_numpy(zero_copy_only=False)


def points(columns: tuple[str, ...], nested: bool):
    """A function over Arrow batches (ids, indicator, p1, p2, p3, k, d, x): the
    points of every range in date order with ``columns``, for each of its ids;
    rows (request_id, date, ..), or ``nested`` (request_id, points)."""

    def given(ids: np.ndarray, lengths: np.ndarray, dates: pa.Array, values: dict) -> pa.RecordBatch:
        n = int(lengths.sum())
        parts = {"date": dates} | {c: pa.array(values[c][0], mask=~values[c][1]) if c in values else pa.nulls(n, pa.float64()) for c in columns}
        if not nested:
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, lengths)), *parts.values()], names=["request_id", *parts])
        ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        rows = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(list(parts.values()), names=list(parts)))
        return pa.RecordBatch.from_arrays([pa.array(ids), rows], names=["request_id", "points"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("d")).to_numpy(zero_copy_only=False)
            kinds = batch.column("indicator")
            for kind in sorted(set(kinds.to_pylist())):
                rows = np.flatnonzero(pc.equal(kinds, kind).to_numpy(zero_copy_only=False))
                rows = rows[np.argsort(size[rows], kind="stable")]
                for piece in _pieces(size[rows]):
                    own = batch.take(pa.array(rows[piece]))
                    lengths = size[rows[piece]].astype(np.int64)
                    filled = np.arange(lengths.max()) < lengths[:, None]
                    flat = own.column("x").flatten()
                    x, there = np.zeros(filled.shape), np.zeros(filled.shape, bool)
                    there[filled] = pc.is_valid(flat).to_numpy(zero_copy_only=False)
                    x[filled] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
                    dates = np.zeros(filled.shape, np.int32)
                    dates[filled] = own.column("d").flatten().cast(pa.int32()).to_numpy(zero_copy_only=False)
                    with np.errstate(all="ignore"):
                        found = _OF[kind](x, there, *[_number(own.column(c)) for c in ("p1", "p2", "p3", "k")])
                    ids = own.column("ids").flatten().to_numpy(zero_copy_only=False)
                    of = np.repeat(np.arange(len(lengths)), pc.list_value_length(own.column("ids")).to_numpy(zero_copy_only=False))
                    for part in _pieces(lengths[of]):
                        at, inside = of[part], filled[of[part]]
                        values = {c: (v[at][inside], ok[at][inside]) for c, (v, ok) in zip(COLUMNS[kind], found)}
                        yield given(ids[part], lengths[at], pa.array(dates[at][inside]).cast(pa.date32()), values)
    return run
