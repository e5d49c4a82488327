"""Rings of a whole Arrow batch as padded arrays: outlines, clipping, distances and WKB without a loop over rows.

A ring's corners stand at the front of its row; what is behind ``size`` has no meaning. A batch is cut into slices
of rows of similar length, so that arrays stay within SLOTS elements whatever the lengths.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridloom.functions.projection import ALPHA, BETA, CIRCLE, DELTA, E, E2, K0, RECTIFYING, A, equal_area_scale

#: Elements of a padded array.
SLOTS = 1 << 19


class Rings:
    """``x`` and ``y`` (rows x corners) and the ``size`` of each ring."""

    def __init__(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> None:
        self.x, self.y, self.size = x, y, size

    @staticmethod
    def packed(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> Rings:
        """From the corners of all rings one after the other."""
        m = int(size.max(initial=0))
        at = np.arange(m) < size[:, None]
        out = Rings(np.zeros((len(size), m)), np.zeros((len(size), m)), size)
        out.x[at], out.y[at] = x, y
        return out

    @property
    def filled(self) -> np.ndarray:
        return np.arange(self.x.shape[1]) < self.size[:, None]

    def take(self, rows: np.ndarray) -> Rings:
        m = int(self.size[rows].max(initial=0))
        return Rings(self.x[rows, :m], self.y[rows, :m], self.size[rows])

    def following(self, *values: np.ndarray) -> list[np.ndarray]:
        """Values of each corner's successor."""
        if not self.x.shape[1]:
            return list(values)
        last = np.maximum(self.size - 1, 0)[:, None]
        at = np.where(np.arange(self.x.shape[1]) < last, np.arange(1, self.x.shape[1] + 1), 0)
        return [np.take_along_axis(v, np.minimum(at, v.shape[1] - 1), 1) for v in values]

    def doubled_area(self) -> np.ndarray:
        """Twice the signed area, positive counter-clockwise; 0 for fewer than three corners."""
        if not self.x.shape[1]:
            return np.zeros(len(self.size))
        x, y = self.x - self.x[:, :1], self.y - self.y[:, :1]  # small numbers lose less
        x2, y2 = self.following(x, y)
        return np.where(self.size >= 3, np.where(self.filled, x * y2 - x2 * y, 0.0).sum(1), 0.0)

    def area(self) -> np.ndarray:
        return np.abs(self.doubled_area()) / 2

    def arrow(self, missing: np.ndarray | None = None) -> pa.ListArray:
        """list<struct<x, y>>; null for ``missing`` rows."""
        at, size = self.filled, self.size
        corners = pa.StructArray.from_arrays([pa.array(self.x[at]), pa.array(self.y[at])], ["x", "y"])
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        mask = None if missing is None or not missing.any() else pa.array(missing)
        return pa.ListArray.from_arrays(pa.array(offsets), corners, mask=mask)


def of_arrow(ring: pa.ListArray) -> tuple[Rings, np.ndarray]:
    """Rings of list<struct<x, y>> and which are null (of size 0 then)."""
    missing = np.asarray(ring.is_null())
    size = pc.fill_null(pc.list_value_length(ring), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    corners = ring.flatten()
    x, y = (corners.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y"))
    return Rings.packed(x, y, size), missing


def by_length(f: Callable[..., np.ndarray], *rings: Rings) -> np.ndarray:
    """``f`` over slices of rows of similar length; its rows in order."""
    longest = np.max([r.size for r in rings], axis=0)
    order, out, i = np.argsort(longest, kind="stable"), None, 0
    while i < len(order):
        # A clipped ring may have as many corners again for each edge that clips it.
        j = i + max(1, int(np.searchsorted(np.arange(1, len(order) - i + 1) * (longest[order[i:]] + 4), SLOTS)))
        part = f(*[r.take(order[i:j]) for r in rings])
        out = np.zeros((len(order), *part.shape[1:]), part.dtype) if out is None else out
        out[order[i:j]] = part
        i = j
    return np.zeros(0) if out is None else out


def clip(subject: Rings, box: Rings) -> Rings:
    """The part of each ring inside the convex ring of the same row, by cutting with one of its edges after the other."""
    turn = np.sign(box.doubled_area())[:, None]
    usable = (subject.size >= 3) & (box.size >= 3)
    cur = Rings(subject.x, subject.y, np.where(usable, subject.size, 0))
    ends = box.following(box.x, box.y)
    for k in range(box.x.shape[1]):
        m = cur.x.shape[1]
        if not m:
            break
        ax, ay, bx, by = (v[:, k : k + 1] for v in (box.x, box.y, *ends))
        cuts = (k < box.size)[:, None]
        side = np.where(cuts, turn * ((bx - ax) * (cur.y - ay) - (by - ay) * (cur.x - ax)), 1.0)
        if (side >= 0)[cur.filled].all():
            continue
        x2, y2, side2 = cur.following(cur.x, cur.y, side)
        crossing = cur.filled & ((side > 0) & (side2 < 0) | (side < 0) & (side2 > 0))
        share = np.divide(side, side - side2, out=np.zeros_like(side), where=crossing)
        kept = np.stack([cur.filled & (side >= 0), crossing], 2).reshape(len(side), 2 * m)
        both = [np.stack([v, v + (w - v) * share], 2).reshape(len(side), 2 * m) for v, w in ((cur.x, x2), (cur.y, y2))]
        size = kept.sum(1)
        front = np.argsort(~kept, axis=1, kind="stable")[:, : size.max(initial=0)]
        cur = Rings(*[np.take_along_axis(v, front, 1) for v in both], size)
    return cur


def clipped_area(subject: Rings, box: Rings) -> np.ndarray:
    return by_length(lambda s, b: clip(s, b).area(), subject, box)


def clipped(subject: Rings, box: Rings) -> Rings:
    """``clip`` for rings of any lengths."""
    parts: list[Rings] = []

    def one(s: Rings, b: Rings) -> np.ndarray:
        parts.append(clip(s, b))
        at = len(parts) - 1
        return np.stack([np.full(len(s.size), at), np.arange(len(s.size))], 1)

    where = by_length(one, subject, box)
    if not len(where):
        return subject
    size = np.zeros(len(where), np.int64)
    for k, p in enumerate(parts):
        size[where[:, 0] == k] = p.size[where[where[:, 0] == k, 1]]
    start = np.concatenate([[0], np.cumsum(size)])
    x, y = np.zeros(start[-1]), np.zeros(start[-1])
    for k, p in enumerate(parts):
        rows = np.flatnonzero(where[:, 0] == k)
        p = Rings(p.x[where[rows, 1]], p.y[where[rows, 1]], p.size[where[rows, 1]])
        to = (start[rows][:, None] + np.arange(p.x.shape[1]))[p.filled]
        x[to], y[to] = p.x[p.filled], p.y[p.filled]
    return Rings.packed(x, y, size)


def canonical(r: Rings, digits: int = 9) -> Rings:
    """Rounded, clockwise, from the least corner (by x, then y) on: equal for equal outlines."""
    x, y = np.round(r.x, digits), np.round(r.y, digits)
    out = Rings(x, y, r.size)
    if not x.shape[1]:
        return out
    low = np.where(r.filled, x, np.inf)
    first = low == low.min(1, keepdims=True)
    start = np.argmin(np.where(first & r.filled, y, np.inf), axis=1)[:, None]
    step = np.where(out.doubled_area() > 0, -1, 1)[:, None]
    at = (start + step * np.arange(x.shape[1])) % np.maximum(r.size, 1)[:, None]
    return Rings(np.take_along_axis(x, at, 1), np.take_along_axis(y, at, 1), r.size)


def wkb(r: Rings, missing: np.ndarray) -> pa.Array:
    """Little-endian WKB polygons with one closed ring each."""
    bytes_of = np.where(missing, 0, 13 + 16 * (r.size + 1))
    start = np.concatenate([[0], np.cumsum(bytes_of)])
    out = np.zeros(start[-1], np.uint8)
    for n in np.unique(r.size[~missing]):
        rows = np.flatnonzero((r.size == n) & ~missing)
        head = np.frombuffer(b"\x01\x03\x00\x00\x00\x01\x00\x00\x00" + np.uint32(n + 1).tobytes(), np.uint8)
        at = np.r_[0:n, 0 : min(n, 1)] if n else np.zeros(1, int)
        corners = np.stack([r.x[rows][:, at], r.y[rows][:, at]], 2) if r.x.shape[1] else np.zeros((len(rows), 1, 2))
        body = np.ascontiguousarray(corners.astype("<f8")).view(np.uint8).reshape(len(rows), -1)
        out[start[rows][:, None] + np.arange(len(head) + body.shape[1])] = np.hstack([np.tile(head, (len(rows), 1)), body])
    valid = None if not missing.any() else pa.array(~missing).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(r.size), [valid, pa.py_buffer(start.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def _to_outline(a: Rings, b: Rings) -> np.ndarray:
    """The greatest distance from a corner of ``a`` to the outline of ``b``."""
    x2, y2 = b.following(b.x, b.y)
    dx, dy = (x2 - b.x)[:, None, :], (y2 - b.y)[:, None, :]
    px, py = a.x[:, :, None] - b.x[:, None, :], a.y[:, :, None] - b.y[:, None, :]
    long = dx * dx + dy * dy
    t = np.clip(np.divide(px * dx + py * dy, long, out=np.zeros_like(px), where=long > 0), 0, 1)
    d = np.where(b.filled[:, None, :], np.hypot(px - t * dx, py - t * dy), np.inf)
    return np.where(a.filled, d.min(2, initial=np.inf), 0.0).max(1, initial=0.0)


def difference(a: Rings, b: Rings) -> np.ndarray:
    """Greatest coordinate difference of the corners of canonical rings; the Hausdorff distance where their numbers differ."""
    out, same = np.full(len(a.size), np.inf), a.size == b.size
    rows = np.flatnonzero(same)
    p, q = a.take(rows), b.take(rows)
    out[rows] = np.where(p.filled, np.maximum(np.abs(p.x - q.x), np.abs(p.y - q.y)), 0.0).max(1, initial=0.0)
    rows = np.flatnonzero(~same & (a.size > 0) & (b.size > 0))
    for i in range(0, len(rows), 1024):
        p, q = a.take(rows[i : i + 1024]), b.take(rows[i : i + 1024])
        out[rows[i : i + 1024]] = np.maximum(_to_outline(p, q), _to_outline(q, p))
    return out


def degrees(x: np.ndarray, y: np.ndarray, epsg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of metres in UTM zones (Krueger's series, as ``projection.utm_inverse``)."""
    xi, eta = (y - np.where(epsg >= 32700, 1e7, 0.0)) / (K0 * RECTIFYING), (x - 500000.0) / (K0 * RECTIFYING)
    a, b = xi.copy(), eta.copy()
    for j, c in enumerate(BETA, 1):
        a -= c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        b -= c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    chi = np.arcsin(np.sin(a) / np.cosh(b))
    lat = chi + sum(c * np.sin(2 * j * chi) for j, c in enumerate(DELTA, 1))
    return (epsg % 100) * 6.0 - 183.0 + np.degrees(np.arctan2(np.sinh(b), np.cos(a))), np.degrees(lat)


def metres(lon: np.ndarray, lat: np.ndarray, epsg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metres in UTM zones of degrees, as ``projection.utm_forward``."""
    lam, t = np.radians(lon - ((epsg % 100) * 6.0 - 183.0)), np.tan(np.radians(lat))
    sigma = np.sinh(E * np.arctanh(E * t / np.sqrt(1 + t * t)))
    t = t * np.sqrt(1 + sigma * sigma) - sigma * np.sqrt(1 + t * t)
    xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.sqrt(t * t + np.cos(lam) ** 2))
    north, east = xi.copy(), eta.copy()
    for j, c in enumerate(ALPHA, 1):
        north += c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        east += c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    return 500000.0 + K0 * RECTIFYING * east, K0 * RECTIFYING * north + np.where(epsg >= 32700, 1e7, 0.0)


def equal_area(lon: np.ndarray, lat: np.ndarray, parallel: float = 30.0) -> tuple[np.ndarray, np.ndarray]:
    """Metres on the equal-area plane, as ``projection.equal_area``."""
    k, s = equal_area_scale(parallel), np.sin(np.radians(lat))
    return A * k * np.radians(lon), A * (1 - E2) * (s / (1 - E2 * s * s) + np.arctanh(E * s) / E) / (2 * k)


def squares(col: np.ndarray, row: np.ndarray, epsg: np.ndarray, side: float) -> Rings:
    """Footprints in degrees of the cells of UTM zones."""
    x = (col[:, None] + np.array([0, 1, 1, 0])) * side
    y = (row[:, None] + np.array([0, 0, 1, 1])) * side
    return Rings(*degrees(x.astype(float), y.astype(float), epsg[:, None]), np.full(len(col), 4))


def square_again(r: Rings, epsg: np.ndarray, side: float, side_tolerance: float, area_tolerance: float) -> np.ndarray:
    """Whether each ring, projected to its zone, has the sides of a cell and its area."""
    x, y = metres(r.x, r.y, epsg[:, None])
    at = r.filled
    # Half a circle up, northings start again; a ring across that place goes on.
    y = np.where(np.where(at, y, -np.inf).max(1, initial=-np.inf)[:, None] - y > CIRCLE / 2, y + CIRCLE, y)
    flat = Rings(x, y, r.size)
    span = [np.where(at, v, -np.inf).max(1, initial=-np.inf) - np.where(at, v, np.inf).min(1, initial=np.inf) for v in (x, y)]
    with np.errstate(invalid="ignore"):
        return (np.abs(span[0] - side) <= side_tolerance) & (np.abs(span[1] - side) <= side_tolerance) & (np.abs(flat.area() - side * side) <= area_tolerance)


def column(values: pa.Array, kind: type = float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of an Arrow column (0 where null) and where it is null."""
    return pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(kind), np.asarray(values.is_null())

