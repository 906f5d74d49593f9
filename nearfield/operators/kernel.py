"""Blocked exact top-K inside one task.

A task streams base rows past one bounded block of queries.  A float32 matrix
product gives a lower bound of every distance; only pairs that may still enter
a query's list are scored in float64, so the kept lists are exact, ties go to
the smaller id, and copies of one vector always get the same distance.

What the product needs of the base is made once per :class:`Tile`, which several blocks of queries may share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_NO_ID = np.iinfo(np.int64).max
_BASE_TILE = 1024
_QUERY_TILE = 512
_SCORE_ELEMENTS = 1 << 16


def to_matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Contiguous float32 matrix of a list column; every row must have ``dims`` elements."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    if dims is None:
        dims = len(values) // n if n else 0
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or (lengths != dims).any():
        raise ValueError(f"a vector does not have {dims} elements; lengths seen: {sorted(set(lengths.tolist()))[:5]}")
    return np.ascontiguousarray(values.reshape(n, dims))


def _squared_norms(matrix: np.ndarray) -> np.ndarray:
    wide = matrix.astype(np.float64)
    return (wide * wide).sum(axis=1)


_buffers: dict[str, np.ndarray] = {}


def _buffer(name: str, shape: tuple[int, int], dtype: type) -> np.ndarray:
    """Memory of this process that every product of a shape goes through; fresh pages would cost as much as the product."""
    size = shape[0] * shape[1]
    key = f"{name} {np.dtype(dtype).char}"
    if key not in _buffers or len(_buffers[key]) < size:
        _buffers[key] = np.empty(size, dtype)
    return _buffers[key][:size].reshape(shape)


def _places(mask: np.ndarray) -> np.ndarray:
    """Flat positions of what is true; eight positions are looked at together where few are."""
    flat = mask.ravel()
    if 32 * np.count_nonzero(flat) > len(flat):
        return np.flatnonzero(flat)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64) != 0)
    at = (8 * words[:, None] + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


def sorted_by(q: np.ndarray, d: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    """Order by (q, d, i); the ids are only looked at when two distances are equal."""
    by_distance = np.argsort(d)
    small = np.uint16 if n <= 1 << 16 else np.int64
    order = by_distance[np.argsort(q[by_distance].astype(small), kind="stable")]
    q, d = q[order], d[order]
    equal = (q[1:] == q[:-1]) & (d[1:] == d[:-1]) & np.isfinite(d[1:])
    if equal.any():
        # Only runs of equal distances are put into the order of their ids.
        tied = np.flatnonzero(np.append(equal, False) | np.append(False, equal))
        order[tied] = order[tied][np.lexsort((i[order[tied]], d[tied], q[tied]))]
    return order


class Tile:
    """Some base rows, with what the screening products of all query blocks need of them; for one metric."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = _squared_norms(vectors)
        self.largest = np.nanmax(self.norms, initial=0.0)
        self._screens: dict[type, tuple[np.ndarray, float]] = {}

    def screen(self, metric: str, dtype: type, factor: float) -> tuple[np.ndarray, float]:
        """Right factor of the screening product, and twice the largest error bound."""
        if dtype not in self._screens:
            if metric == "cos":
                with np.errstate(invalid="ignore", divide="ignore"):
                    scaled = self.vectors / np.sqrt(self.norms)[:, None]
                error = np.full(len(self.ids), factor)
                bias = -error
            else:
                scaled = self.vectors
                error = factor * self.norms
                bias = (self.norms if metric == "l2" else 0.0) - error
            right = np.hstack([scaled, bias[:, None]]).astype(dtype)
            self._screens[dtype] = right, 2.0 * float(np.nanmax(error, initial=0.0)) + 1e-30
        return self._screens[dtype]


def tiles(ids: np.ndarray, vectors: np.ndarray) -> Iterator[Tile]:
    for start in range(0, len(ids), _BASE_TILE):
        yield Tile(ids[start : start + _BASE_TILE], vectors[start : start + _BASE_TILE])


class BlockTopK:
    """Running top-K lists of a fixed set of queries."""

    def __init__(self, queries: np.ndarray, k: int, metric: str, codes: bool = False):
        """``codes``: all vectors, of the base too, hold whole numbers from -128 to 127."""
        n, dims = queries.shape
        self.k, self.metric, self.dims = k, metric, dims
        # Where sums of whole numbers are exact.
        self._exact = None if not codes else np.float32 if 4 * dims * 128**2 < 1 << 24 else np.float64
        self.queries = queries.astype(np.float64)
        self._codes = queries.astype(self._exact) if codes else None
        self.norms = _squared_norms(queries)
        self.distances = np.full((n, k), np.inf)
        self.ids = np.full((n, k), _NO_ID, dtype=np.int64)
        self._pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._pending_rows = 0
        self._flush_at = max(n * k, 1 << 16)
        self._screens: dict[type, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _query_screen(self, dtype: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Left factor of the screening product, per-query offset and error bound."""
        if dtype not in self._screens:
            factor = self._error_factor(dtype)
            if self.metric == "l2":
                left, offset, error = -2.0 * self.queries, self.norms, factor * self.norms
            elif self.metric == "ip":
                left, offset, error = -self.queries, np.ones(len(self.queries)), factor * self.norms
            else:
                left = -self.queries / np.sqrt(np.where(self.norms > 0, self.norms, np.nan))[:, None]
                offset, error = np.ones(len(self.queries)), np.full(len(self.queries), factor)
            left = np.hstack([left, np.ones((len(left), 1))]).astype(dtype)
            self._screens[dtype] = (left, offset - error, error)
        return self._screens[dtype]

    def _error_factor(self, dtype: type) -> float:
        # Rounding of a product of length dims + 1, doubled to cover the norms.
        return 2.0 * (self.dims + 16) * float(np.finfo(dtype).eps)

    def offer(self, ids: np.ndarray, vectors: np.ndarray, members: np.ndarray | None = None) -> None:
        """Present base rows to all queries, or only to the query positions ``members``."""
        for tile in tiles(ids, vectors):
            self.offer_tile(tile, members)

    def offer_tile(self, tile: Tile, members: np.ndarray | None = None) -> None:
        members = np.arange(len(self.queries)) if members is None else members
        (self._offer_codes if self._exact else self._offer_tile)(tile, members)
        # A few queries' limits tighten long before all lists together would be merged.
        if self._pending_rows >= max(len(members) * self.k // 2, 1 << 14):
            self._flush()

    def _offer_tile(self, tile: Tile, members: np.ndarray) -> None:
        largest = max(tile.largest, np.nanmax(self.norms, initial=0.0))
        dtype = np.float32 if largest < 1e30 else np.float64
        right, slack = tile.screen(self.metric, dtype, self._error_factor(dtype))
        left, offset, query_error = self._query_screen(dtype)
        for start in range(0, len(members), _QUERY_TILE):
            part = members[start : start + _QUERY_TILE]
            shape = len(part), len(right)
            low = np.matmul(left[part], right.T, out=_buffer("product", shape, dtype))
            limit = self.distances[part, -1] - offset[part] + 1e-30
            mask = np.less_equal(low, self._ceil(limit, dtype)[:, None], out=_buffer("mask", shape, bool))
            found = _places(mask)
            if len(found) > 2 * self.k * len(part):
                # At least k rows lie below the k-th lower bound plus the error bound.
                crowded = np.flatnonzero(mask.sum(axis=1) >= self.k)
                kth = np.partition(low[crowded], self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)
                tighter = np.minimum(limit[crowded], kth + slack + 2.0 * query_error[part[crowded]])
                mask[crowded] = low[crowded] <= self._ceil(tighter, dtype)[:, None]
                found = _places(mask)
            if len(found):
                positions, rows = np.divmod(found, mask.shape[1])
                self._score(part[positions], rows, tile)

    def _offer_codes(self, tile: Tile, members: np.ndarray) -> None:
        """As :meth:`_offer_tile` where the matrix product is exact already."""
        dtype = self._exact
        ids, norms = tile.ids, tile.norms
        right, norms32 = tile.vectors.astype(dtype, copy=False).T, norms.astype(dtype)
        for start in range(0, len(members), _QUERY_TILE):
            part = members[start : start + _QUERY_TILE]
            shape = len(part), len(ids)
            gaps = np.matmul(self._codes[part], right, out=_buffer("product", shape, dtype))
            if self.metric == "l2":
                # |a|^2 + |b|^2 - 2ab without the query's own share.
                gaps *= -2
                gaps += norms32
                limit = self.distances[part, -1] - self.norms[part]
            elif self.metric == "ip":
                np.negative(gaps, out=gaps)
                limit = self.distances[part, -1] - 1.0
            else:
                with np.errstate(invalid="ignore", divide="ignore"):
                    gaps = 1.0 - gaps / (np.sqrt(self.norms[part])[:, None] * np.sqrt(norms)[None, :])
                limit = self.distances[part, -1]
            mask = np.less_equal(gaps, limit.astype(gaps.dtype)[:, None], out=_buffer("mask", shape, bool))
            found = _places(mask)
            if len(found) > 2 * self.k * len(part):
                crowded = np.flatnonzero(mask.sum(axis=1) >= self.k)
                kth = np.partition(gaps[crowded], self.k - 1, axis=1)[:, self.k - 1]
                mask[crowded] &= gaps[crowded] <= kth[:, None]
                found = _places(mask)
            if len(found):
                q, r = np.divmod(found, mask.shape[1])
                exact = gaps.ravel()[found].astype(np.float64)
                exact = exact + self.norms[part[q]] if self.metric == "l2" else exact + 1.0 if self.metric == "ip" else exact
                self._pending.append((part[q], exact, ids[r]))
                self._pending_rows += len(found)
                if self._pending_rows >= self._flush_at:
                    self._flush()

    @staticmethod
    def _ceil(limit: np.ndarray, dtype: type) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.nextafter(limit.astype(dtype), dtype(np.inf))

    def _score(self, queries: np.ndarray, rows: np.ndarray, tile: Tile) -> None:
        step = max(1, _SCORE_ELEMENTS // max(self.dims, 1))
        ids, norms = tile.ids, tile.norms
        for start in range(0, len(queries), step):
            q, r = queries[start : start + step], rows[start : start + step]
            a, b = self.queries[q], tile.vectors[r].astype(np.float64)
            if self.metric == "l2":
                difference = a - b
                exact = (difference * difference).sum(axis=1)
            else:
                exact = (a * b).sum(axis=1)
                if self.metric == "cos":
                    exact = exact / (np.sqrt(self.norms[q]) * np.sqrt(norms[r]))
                exact = 1.0 - exact
            keep = exact <= self.distances[q, -1]
            keep &= np.isfinite(exact)
            if keep.any():
                self._pending.append((q[keep], exact[keep], ids[r[keep]]))
                self._pending_rows += int(keep.sum())
            if self._pending_rows >= self._flush_at:
                self._flush()

    def _flush(self) -> None:
        if not self._pending:
            return
        q, d, i = (np.concatenate(x) for x in zip(*self._pending))
        self._pending, self._pending_rows = [], 0
        by_query = np.argsort(q, kind="stable")
        q, d, i = q[by_query], d[by_query], i[by_query]
        touched = np.unique(q)
        # Some queries at a time: a merge needs several times the memory of their lists.
        for start in range(0, len(touched), _QUERY_TILE):
            some = touched[start : start + _QUERY_TILE]
            new = slice(np.searchsorted(q, some[0]), np.searchsorted(q, some[-1], side="right"))
            self._merge(some, q[new], d[new], i[new])

    def _merge(self, touched: np.ndarray, q: np.ndarray, d: np.ndarray, i: np.ndarray) -> None:
        q = np.concatenate([q, np.repeat(touched, self.k)])
        d = np.concatenate([d, self.distances[touched].ravel()])
        i = np.concatenate([i, self.ids[touched].ravel()])
        order = sorted_by(q, d, i, len(self.queries))
        starts = np.searchsorted(q[order], touched)
        best = order[(starts[:, None] + np.arange(self.k)[None, :])]
        self.distances[touched] = d[best]
        self.ids[touched] = i[best]

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, id, distance) of every kept hit, in query order and best first."""
        self._flush()
        kept = self.ids != _NO_ID
        return np.nonzero(kept)[0], self.ids[kept], self.distances[kept]
