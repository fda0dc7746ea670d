"""Numpy kernels of the similarity operators: one text, or one tile of a group.

Tasks get these functions by value, so workers need no installed package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1024            # rows of one matrix product
SLACK = 1e-9            # of bounds on cosines, against rounding


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def hashed_rows(buckets: np.ndarray, starts: np.ndarray, lo: int, hi: int, width: int,
                 idf: np.ndarray | None) -> np.ndarray:
    """Unit vectors of sentences lo..hi-1 from the flat bucket list."""
    row = np.repeat(np.arange(hi - lo), np.diff(starts[lo:hi + 1]))
    cell = row * width + buckets[starts[lo]:starts[hi]]
    counts = np.bincount(cell, minlength=(hi - lo) * width).astype(float)
    rows = counts.reshape(hi - lo, width)
    return unit(rows if idf is None else rows * idf)


def one_document(buckets: np.ndarray, sizes: np.ndarray, width: int,
                  idf: np.ndarray | None) -> list[tuple[float, float, float]]:
    """Similarities of all sentences of one text, in blocks of bounded size."""
    n = len(sizes)
    if n == 1:
        return [(0.0, 0.0, 0.0)]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    adjacent, mean, top = np.zeros(n), np.zeros(n), np.zeros(n)
    running, last = np.zeros(width), np.zeros(width)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        rows = hashed_rows(buckets, starts, lo, hi, width, idf)
        shifted = np.vstack([last, rows[:-1]])
        adjacent[lo:hi] = np.einsum("ij,ij->i", rows, shifted)
        before = running + np.cumsum(shifted, axis=0) - last
        mean[lo:hi] = np.einsum("ij,ij->i", rows, before) / np.maximum(np.arange(lo, hi), 1)
        inner = rows @ rows.T
        inner[np.triu_indices(hi - lo)] = -np.inf
        best = inner.max(axis=1)
        for other in range(0, lo, BLOCK):
            earlier = hashed_rows(buckets, starts, other, other + BLOCK, width, idf)
            best = np.maximum(best, (rows @ earlier.T).max(axis=1))
        top[lo:hi] = best
        running, last = running + rows.sum(axis=0), rows[-1]
    if n:
        top[0] = 0.0
    return list(zip(adjacent.tolist(), mean.tolist(), top.tolist()))


# --- rows of embedding tables ---------------------------------------------------------

def grouped(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of each run of rows that agree in the columns ``names``."""
    key, held = None, []

    def rows() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        found = list(zip(*[batch.column(n).to_pylist() for n in names]))
        edges = [0, *(i for i in range(1, len(found)) if found[i] != found[i - 1]), len(found)]
        for begin, end in zip(edges, edges[1:]):
            if begin == end:
                continue
            if held and found[begin] != key:
                yield key, rows()
                held = []
            key = found[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield key, rows()


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors, null ones as zero."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    if out.size:
        out[sizes > 0] = np.asarray(pc.fill_null(column.flatten(), 0.0)).reshape(-1, out.shape[1])
    return unit(out)


def ball(rows: np.ndarray) -> tuple[np.ndarray, float, bool]:
    """(centre, angle, zero): the ball on the sphere round unit vectors, and whether zero vectors are among them."""
    some = rows[rows.any(axis=1)]
    if not len(some):
        return np.zeros(rows.shape[1]), 0.0, True
    centre = unit(some.sum(axis=0, keepdims=True))[0]
    return centre, float(np.arccos(np.clip((some @ centre).min(), -1, 1))), len(some) < len(rows)


def ceiling(near: np.ndarray, angle: np.ndarray | float, zero: np.ndarray | bool) -> np.ndarray:
    """The most a cosine with a row of a ball can be, given the cosine with its centre."""
    most = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - angle))
    return np.where(zero, np.maximum(most, 0.0), most) + SLACK


def best_earlier(rows: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """(largest cosine of each row with the rows before it, -inf where there are none; blocks skipped).

    ``before`` is a row that comes before them all.  Earlier blocks are tried in the order of what they
    promise; rows that a block can't improve take no part in its product.
    """
    best, skipped = np.full(len(rows), -np.inf), 0
    balls: list[tuple[np.ndarray, float, bool]] = []
    for low in range(0, len(rows), BLOCK):
        part = rows[low:low + BLOCK]
        inner = part @ part.T
        inner[np.triu_indices(len(part))] = -np.inf
        own = inner.max(axis=1)
        last = rows[low - 1] if low else before
        if last is not None:
            own[0] = max(own[0], part[0] @ last)
        if balls:
            centres, angles, zeros = (np.array(c) for c in zip(*balls))
            most = ceiling(part @ centres.T, angles, zeros)
            for j in np.argsort(-most.max(axis=0)):
                open_ = most[:, j] > own
                if open_.any():
                    own[open_] = np.maximum(own[open_], (part[open_] @ rows[j * BLOCK:(j + 1) * BLOCK].T).max(axis=1))
                else:
                    skipped += 1
        best[low:low + BLOCK] = own
        balls.append(ball(part))
    return best, skipped


def sums_before(rows: np.ndarray) -> np.ndarray:
    """Of each row the product with the sum of the rows before it."""
    out, running = np.zeros(len(rows)), np.zeros(rows.shape[1])
    for low in range(0, len(rows), BLOCK):
        part = rows[low:low + BLOCK]
        before = np.vstack([running, part[:-1]]).cumsum(axis=0)
        out[low:low + BLOCK] = np.einsum("ij,ij->i", part, before)
        running = before[-1] + part[-1]
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """(keys, _order, adjacent, mean_previous, max_previous) of groups that come row after row."""
    for _, batch in grouped(batches, keys):
        rows = matrix(batch.column("_v"))
        adjacent = np.r_[0.0, np.einsum("ij,ij->i", rows[1:], rows[:-1])]
        best, _ = best_earlier(rows)
        mean = sums_before(rows) / np.maximum(np.arange(len(rows)), 1)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(k) for k in keys], batch.column("_order"), pa.array(adjacent), pa.array(mean),
             pa.array(best, mask=np.isinf(best))], [*keys, "_order", "adjacent", "mean_previous", "max_previous"])


def stripes(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """What each row of a stripe finds inside it and with the row before it; on the first row the summary."""
    for _, batch in grouped(batches, [*keys, "_stripe"]):
        context = bool(batch.column("_context")[0].as_py())
        rows = matrix(batch.column("_v"))
        before, rows, batch = (rows[0], rows[1:], batch.slice(1)) if context else (None, rows, batch)
        if not len(rows):  # the group ends with the stripe before
            continue
        first = 0.0 if before is None else float(rows[0] @ before)
        adjacent = np.r_[first, np.einsum("ij,ij->i", rows[1:], rows[:-1])]
        best, _ = best_earlier(rows, before)
        centre, angle, zero = ball(rows)
        names = [*keys, "_stripe", "_at", "_order"]
        none = [None] * (len(rows) - 1)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names], pa.array(adjacent), pa.array(sums_before(rows)),
             pa.array(best, mask=np.isinf(best)), pa.array([rows.sum(axis=0).tolist(), *none], pa.list_(pa.float64())),
             pa.array([centre.tolist(), *none], pa.list_(pa.float64())), pa.array([angle, *none], pa.float64()),
             pa.array([zero, *none], pa.bool_()), pa.array([float(best.min()), *none], pa.float64())],
            [*names, "_adjacent", "_total", "_best", "_sum", "_centre", "_angle", "_zero", "_least"])


def tiles(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """(keys, _at, _total, _best) of the rows (_kind 1) of a stripe against an earlier one (_kind 0), or, in
    tile (i, -1), against the sum of all before it."""
    for key, batch in grouped(batches, [*keys, "_i", "_j"]):
        kind = np.asarray(batch.column("_kind"))
        n = int((kind == 0).sum())
        if not n or n == len(kind):  # the first stripe has nothing before it
            continue
        asked = batch.slice(n)
        rows = matrix(asked.column("_v"))
        none = pa.nulls(len(rows), pa.float64())
        if key[-1] < 0:
            total = rows @ np.asarray(batch.column("_v")[0].values)
            made = [pa.array(total), none]
        else:
            earlier = matrix(batch.column("_v").slice(0, n))
            best = np.array(asked.column("_best").fill_null(-np.inf))
            for low in range(0, n, BLOCK):
                part = earlier[low:low + BLOCK]
                centre, angle, zero = ball(part)
                open_ = ceiling(rows @ centre, angle, zero) > best
                for begin in range(0, len(rows), BLOCK):
                    here = np.flatnonzero(open_[begin:begin + BLOCK]) + begin
                    if len(here):
                        best[here] = np.maximum(best[here], (rows[here] @ part.T).max(axis=1))
            made = [none, pa.array(best)]
        yield pa.RecordBatch.from_arrays([*[asked.column(k) for k in keys], asked.column("_at"), *made],
                                         [*keys, "_at", "_total", "_best"])
