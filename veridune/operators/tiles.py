"""All pairs of a table's vectors, by matrix products.

Rows are dealt to blocks by a hash of their id, a cell is a pair of blocks, and each unordered pair of rows meets in one cell.  A task
holds one cell, of ``ROWS`` rows a block or so however large the table is, and looks at it in tiles; rows cross the network as packed
bytes, once a block.  Work grows as the square of the rows.

Cosines are first taken in single precision, where the product of two unit vectors is off by less than ``_margin``; whatever that leaves
open is decided by the sum that ``stats.dot`` takes, in doubles and in its order.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't hold this package

ROWS = 1 << 15
GRID = 8  # blocks of a table that fits into fewer, for tasks enough
FEW = 256  # no block of fewer rows
TILE = (512, 2048)
SOME = 1 << 16  # pairs looked at together


def _packed(kind: str):
    def rows(batches):
        for batch in batches:
            v, blk, s = batch["v"], batch["blk"].to_numpy(), batch["s"]
            values, off = v.values, np.asarray(v.offsets)
            if values.null_count:
                gaps = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()))])
                whole = gaps[off[1:]] == gaps[off[:-1]]
                values = pc.fill_null(values, 0.0)
            else:
                whole = np.ones(len(v), bool)
            flat, size = np.asarray(values).astype(kind, copy=False), np.diff(off)
            sides, width = np.asarray(s.values).astype(np.uint8), np.diff(np.asarray(s.offsets))
            start = np.asarray(s.offsets)
            order = np.lexsort((blk, size))
            order = order[whole[order] & (size[order] > 0)]
            if not len(order):
                continue
            new = np.flatnonzero(np.diff(size[order]) | np.diff(blk[order])) + 1
            for own in np.split(order, new):
                d, w = size[own[0]], width[own[0]]
                x = flat[off[own][:, None] + np.arange(d)]
                t = sides[start[own][:, None] + np.arange(w)]
                ids = batch["id"].take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([blk[own[0]]], pa.int32()), pa.array([d], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids), pa.array([x.tobytes()], pa.binary()), pa.array([t.tobytes()], pa.binary())],
                    names=["blk", "dim", "ids", "v", "s"],
                )

    return rows


def _worked(kind: str, work, one_dim: bool):
    def rows(batches):
        held: dict = {}
        for batch in batches:
            cell, lo, blk, dim = (batch[c].to_pylist() for c in ("cell", "lo", "blk", "dim"))
            for k in range(batch.num_rows):
                part = (batch["ids"][k].values, np.frombuffer(batch["v"][k].as_py(), kind).reshape(-1, dim[k]), np.frombuffer(batch["s"][k].as_py(), np.uint8))
                held.setdefault(cell[k], {}).setdefault(dim[k], {}).setdefault(blk[k] == lo[k], []).append(part)
                diagonal[cell[k]] = batch["hi"][k].as_py() == lo[k]
        for c in sorted(held):
            if one_dim and len(held[c]) > 1:
                raise ValueError(f"vectors of different lengths: {sorted(held[c])}")
            for d in sorted(held[c]):
                sides = held[c][d]
                blocks = [_block(sides[first]) if first in sides else None for first in (True, False)]
                if blocks[0] is not None and (diagonal[c] or blocks[1] is not None):
                    with np.errstate(all="ignore"):
                        yield from work(blocks[0], blocks[1])
            del held[c]

    diagonal: dict = {}
    return rows


def _block(parts):
    ids = pa.concat_arrays([p[0] for p in parts])
    return ids, np.concatenate([p[1] for p in parts]).astype(np.float64), np.concatenate([p[2] for p in parts]).reshape(len(ids), -1)


def cells(df: DataFrame, id_col: str, vector: str, work, schema: str, sides: Column | None = None, n: int | None = None, one_dim: bool = False) -> DataFrame:
    """What work(block, other) yields over all cells; a block is (ids, vectors, sides), other is None where a block meets itself.

    Rows without id or vector, or with a null in it, take no part; vectors meet those of their own length.
    """
    n = df.count() if n is None else n
    g = max(1, -(-n // ROWS), min(GRID, -(-n // FEW)))
    single = isinstance(df.schema[vector].dataType, ArrayType) and isinstance(df.schema[vector].dataType.elementType, FloatType)
    kind, v = ("<f4", F.col(vector)) if single else ("<f8", F.transform(vector, lambda x: x.cast("double")))
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), v.alias("v"), F.pmod(F.xxhash64(id_col), F.lit(g)).cast("int").alias("blk"), (F.array().cast("array<boolean>") if sides is None else sides).alias("s"))
    packed = rows.mapInArrow(_packed(kind), f"blk int, dim int, ids array<{id_type}>, v binary, s binary")
    each = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(g - 1)))).withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other")).drop("other")
    each = each.withColumn("cell", (F.col("hi") * (F.col("hi") + 1) / 2).cast("int") + F.col("lo"))
    return each.repartitionById(g * (g + 1) // 2, F.col("cell")).mapInArrow(_worked(kind, work, one_dim), schema)


# -- cosines -----------------------------------------------------------------------------------------------------------


def _margin(dim: int) -> float:
    return (dim + 8) * 2.0**-23


class _Unit:
    """Rows of some length: doubles by column, lengths, unit vectors in single precision (0 for odd rows, whose pairs are all taken exactly)."""

    def __init__(self, block):
        ids, v, _ = block
        total = np.zeros(len(v))
        for c in v.T:
            total += c * c
        length = np.sqrt(total)
        keep = np.flatnonzero(~(length <= 0))  # NaN counts as greater, as in SQL
        self.ids, self.v, self.length = ids.take(pa.array(keep)), v[keep], length[keep]
        self.odd = ~((self.length > 1e-100) & (self.length < 1e100))
        self.u = (self.v / self.length[:, None]).astype(np.float32)
        self.u[self.odd] = 0
        self.cols = np.ascontiguousarray(self.v.T)

    def __len__(self):
        return len(self.length)


def _cosines(a: _Unit, b: _Unit, i, j):
    out = np.zeros(len(i))
    for s in range(0, len(i), SOME):
        p, q = i[s : s + SOME], j[s : s + SOME]
        part = out[s : s + SOME]
        for x, y in zip(a.cols, b.cols, strict=True):
            part += x[p] * y[q]
        part /= a.length[p] * b.length[q]
    return out


def _ranks(a: _Unit, b: _Unit | None):
    """Numbers in the order of ids; equal ids have equal ones."""
    r = pc.rank(pa.concat_arrays([a.ids, b.ids]) if b is not None else a.ids, tiebreaker="dense").to_numpy().astype(np.int64)
    return (r[: len(a)], r[len(a) :]) if b is not None else (r, r)


def _open(p, a: _Unit, b: _Unit, rows, cols, least: float):
    """Indices of a tile's pairs that may reach ``least``."""
    hit = p >= least
    hit[a.odd[rows]] = True
    hit[:, b.odd[cols]] = True
    i, j = np.divmod(np.flatnonzero(hit), p.shape[1])
    return rows[i], cols[j], p[i, j]


def _tiles(rows, cols):
    for r in range(0, len(rows), TILE[0]):
        for c in range(0, len(cols), TILE[1]):
            yield rows[r : r + TILE[0]], cols[c : c + TILE[1]]


def pairs_from(threshold: float):
    """work: (a, b, cosine) of all pairs whose cosine reaches the threshold."""

    def work(block, other):
        a = _Unit(block)
        b = a if other is None else _Unit(other)
        if not len(a) or not len(b):
            return
        ra, rb = _ranks(a, None if other is None else b)
        least = threshold - _margin(a.u.shape[1])
        for rows, cols in _tiles(np.arange(len(a)), np.arange(len(b))):
            if other is None and cols[-1] <= rows[0]:
                continue
            i, j, _ = _open(a.u[rows] @ b.u[cols].T, a, b, rows, cols, least)
            keep = ra[i] != rb[j]
            if other is None:
                keep &= i < j
            i, j = i[keep], j[keep]
            for s in range(0, len(i), SOME):
                p, q = i[s : s + SOME], j[s : s + SOME]
                cos = _cosines(a, b, p, q)
                keep = ~(cos < threshold)
                p, q, cos = p[keep], q[keep], cos[keep]
                swap = pa.array(ra[p] > rb[q])
                x, y = a.ids.take(pa.array(p)), b.ids.take(pa.array(q))
                if len(p):
                    yield pa.RecordBatch.from_arrays([pc.if_else(swap, y, x), pc.if_else(swap, x, y), pa.array(cos)], names=["a", "b", "cosine"])

    return work


def _merged(label, i, j):
    """label, the least index known of each row's component, after the edges (i, j)."""
    while True:
        a, b = label[i], label[j]
        live = a != b
        if not live.any():
            return label
        i, j, a, b = i[live], j[live], a[live], b[live]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (far := to[to]).tobytes() != to.tobytes():
            to = far
        label = to[label]


def forest_from(threshold: float):
    """work: (a, b) edges that connect within a cell what its pairs at or above the threshold connect, a row at most an edge.

    Pairs inside a component that is known by then are not looked at.
    """

    def work(block, other):
        a = _Unit(block)
        b = a if other is None else _Unit(other)
        if not len(a) or not len(b):
            return
        at = 0 if other is None else len(a)
        ra, rb = _ranks(a, None if other is None else b)
        rank = ra if other is None else np.concatenate([ra, rb])
        label, margin = np.arange(len(rank)), _margin(a.u.shape[1])
        for r in range(0, len(a), TILE[0]):
            slab, against = np.arange(r, min(r + TILE[0], len(a))), np.arange(r if other is None else 0, len(b))
            most = np.bincount(label).argmax()
            own, rest = label[slab] == most, label[at + against] != most
            for some, others in ((slab[~own], against), (slab[own], against[rest])):
                for rows, cols in _tiles(some, others):
                    i, j, p = _open(a.u[rows] @ b.u[cols].T, a, b, rows, cols, threshold - margin)
                    keep = (label[i] != label[at + j]) & (ra[i] != rb[j])
                    i, j, p = i[keep], j[keep], p[keep]
                    sure = (p >= threshold + margin) & ~a.odd[i] & ~b.odd[j]
                    label = _merged(label, i[sure], at + j[sure])
                    i, j = i[~sure], j[~sure]
                    keep = label[i] != label[at + j]
                    i, j = i[keep], j[keep]
                    keep = ~(_cosines(a, b, i, j) < threshold)
                    label = _merged(label, i[keep], at + j[keep])
        order = np.lexsort((rank, label))
        first = np.concatenate([[True], np.diff(label[order]) != 0])
        root = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        keep = rank[order] != rank[root]
        ids = a.ids if other is None else pa.concat_arrays([a.ids, b.ids])
        if keep.any():
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(root[keep])), ids.take(pa.array(order[keep]))], names=["a", "b"])

    return work


class _Nearest:
    """Of each of n rows the candidates (key, other) that may still be the greatest, equal keys by the least other's rank."""

    def __init__(self, n: int, rank):
        self.n, self.rank, self.bar = n, rank, np.full(n, -np.inf, np.float32)
        self.held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        self.waiting = self.settled = 0

    def add(self, row, key, other):
        self.held.append((row, key, other))
        self.waiting += len(row)
        if self.waiting > max(16 * SOME, self.settled):
            self.settle()

    def settle(self):
        row, key, other = (np.concatenate(c) for c in zip(*self.held, strict=True))
        key = np.where(np.isnan(key), np.inf, key)  # NaN is the greatest
        order = np.lexsort((self.rank[other], -key, row))
        row, key, other = row[order], key[order], other[order]
        top = np.full(self.n, -np.inf)
        np.maximum.at(top, row, key)
        keep = (key == top[row]) | (key >= top[row] - 4e-12)  # what rounding to 12 places may make equal
        keep[1:] &= (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        self.held = [(row[keep], key[keep], other[keep])]
        self.waiting, self.settled = 0, int(keep.sum())
        return self.held[0]


def _told(ids, others, row, key, other):
    if len(row):
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), others.take(pa.array(other)), pa.array(np.where(np.isinf(key), np.nan, key))], names=["id", "neighbour", "cosine"])


def _distinct(x: _Unit, rank):
    """Each distinct vector once, by the row of its least id, and each row's place among them."""
    order = np.argsort(rank, kind="stable")
    v = np.ascontiguousarray(x.v[order])
    _, first, place = np.unique(v.view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    back = np.empty(len(order), np.int64)
    back[order] = place
    return order[first], back


def nearest_in():
    """work: (id, neighbour, cosine), the candidates of each row of a cell for its greatest cosine."""

    def work(block, other):
        a = _Unit(block)
        b = a if other is None else _Unit(other)
        if not len(a) or not len(b):
            return
        ra, rb = _ranks(a, None if other is None else b)
        unique = other is not None or len(np.unique(ra)) == len(ra)
        everything = np.arange(len(a)), np.arange(len(a))
        (ua, pa_), (ub, pb) = (_distinct(a, ra) if unique else everything), (_distinct(b, rb) if unique else everything)
        best_a, best_b = _Nearest(len(a), rb), _Nearest(len(b), ra)
        margin = np.float32(3 * _margin(a.u.shape[1]))
        for rows, cols in _tiles(ua, ub):
            p = a.u[rows] @ b.u[cols].T
            apart = None
            if other is None:
                apart = ra[rows][:, None] != rb[cols][None, :]
                p[~apart] = -4
            for best, mine, axis in ((best_a, rows, 1), (best_b, cols, 0)) if other is not None else ((best_a, rows, 1),):
                best.bar[mine] = np.maximum(best.bar[mine], p.max(axis=axis))
                bar = best.bar[mine] - margin
                hit = p >= (bar[:, None] if axis else bar[None, :])
                hit[a.odd[rows]] = True
                hit[:, b.odd[cols]] = True
                if apart is not None:
                    hit &= apart
                i, j = np.divmod(np.flatnonzero(hit), len(cols))
                i, j = rows[i], cols[j]
                for s in range(0, len(i), SOME):
                    x, y = i[s : s + SOME], j[s : s + SOME]
                    key = _cosines(a, b, x, y)
                    best.add(x, key, y) if axis else best.add(y, key, x)
        for best, ids, others, u, place in ((best_a, a.ids, b.ids, ua, pa_), (best_b, b.ids, a.ids, ub, pb)) if other is not None else ((best_a, a.ids, a.ids, ua, pa_),):
            row, key, found = best.settle()
            lo, hi = np.searchsorted(row, u, "left"), np.searchsorted(row, u, "right")
            many = (hi - lo)[place]  # candidates of each row's vector
            rows = np.repeat(np.arange(len(place)), many)
            at = np.repeat(lo[place], many) + np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
            yield from _told(ids, others, rows, key[at], found[at])
        if other is None and unique and len(ua) < len(a):  # copies: the least id, and for that itself the next one
            order = np.lexsort((ra, pa_))
            again = np.flatnonzero(pa_[order][1:] == pa_[order][:-1]) + 1
            row, to = order[again], ua[pa_[order[again]]]
            second = again[pa_[order][again - 1] != np.concatenate([[-1], pa_[order]])[again - 1]]
            row, to = np.concatenate([row, order[second - 1]]), np.concatenate([to, order[second]])
            yield from _told(a.ids, a.ids, row, _cosines(a, a, row, to), to)

    return work


# -- sums --------------------------------------------------------------------------------------------------------------


def sums_of(sigma: float | None):
    """work: (round, tt, ff, tf, nt, nf), sums over a cell's pairs of the Gaussian kernel of width sigma, or of distances where that is None."""

    def work(block, other):
        (_, va, sa), (_, vb, sb) = block, other or block
        one = other is None
        sa, sb = (np.concatenate([s, np.ones((len(s), 1))], axis=1) for s in (sa, sb))  # the last column: all rows
        la, lb = (va * va).sum(axis=1), (vb * vb).sum(axis=1)
        tt, tf, total = np.zeros(sa.shape[1]), np.zeros(sa.shape[1]), 0.0

        def kernel(r, c):
            k = va[r] @ vb[c].T
            k *= -2
            k += la[r][:, None]
            k += lb[c]
            np.maximum(k, 0.0, out=k)
            if sigma is None:
                return np.sqrt(k, out=k)
            k *= -1 / (2 * sigma**2)
            return np.exp(k, out=k)

        for r in range(0, len(va), TILE[0]):
            r = slice(r, min(r + TILE[0], len(va)))
            parts = [(slice(c, c + TILE[1]), False) for c in range(r.stop if one else 0, len(vb), TILE[1])] + ([(r, True)] if one else [])
            for c, square in parts:
                k = kernel(r, c)
                if square:
                    np.fill_diagonal(k, 0.0)
                m = k @ sb[c]
                both, mine = (sa[r] * m).sum(axis=0), sa[r].T @ m[:, -1]
                if square:
                    tt, tf, total = tt + both / 2, tf + mine - both, total + m[:, -1].sum() / 2
                else:
                    tt, tf, total = tt + both, tf + m.sum(axis=0) + mine - 2 * both, total + m[:, -1].sum()
        there = sa.sum(axis=0) if one else np.zeros(sa.shape[1])
        gone = len(va) - there if one else there
        cols = {"round": np.arange(len(tt)), "tt": tt, "ff": total - tt - tf, "tf": tf, "nt": there, "nf": gone}
        yield pa.RecordBatch.from_pydict({k: x[:-1] for k, x in cols.items()})

    return work
