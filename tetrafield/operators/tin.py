"""Triangulations that follow several surfaces within an error: one basin is one group, basins run in parallel.

Refinement is sequential by nature, so it runs in Python within a group; a basin has thousands of samples, not millions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SNAP = 1e-9  # of the extent, fixed value: vertices nearer than this are one
BLOCK = 2_000_000  # pairs of a sample and a triangle that are looked at together


class Delaunay:
    """Incremental Delaunay triangulation: a new vertex empties the circles that hold it, and fans out to the rim of the hole."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        centre, reach = (low + high) / 2, 20 * max(float((high - low).max()), 1e-12)
        self.points = [centre + reach * np.array(d) for d in ((-1.0, -1.0), (1.0, -1.0), (0.0, 1.0))]
        self.triangles = np.array([[0, 1, 2]])
        self.circles = np.array([self._circle(0, 1, 2)])
        self.snap = SNAP * float((high - low).max())

    def _circle(self, a: int, b: int, c: int) -> tuple[float, float, float]:
        (ax, ay), (bx, by), (cx, cy) = self.points[a], self.points[b], self.points[c]
        bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (bx * cy - by * cx)
        if d == 0:
            return ax, ay, math.inf
        x, y = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return ax + x, ay + y, x * x + y * y

    def insert(self, p: Sequence[float]) -> int:
        """The vertex's number; one that is there already is found again."""
        p = np.asarray(p, float)
        near = np.abs(np.array(self.points) - p).max(1)
        if near.min() <= self.snap:
            return int(near.argmin())
        self.points.append(p)
        hit = ((self.circles[:, :2] - p) ** 2).sum(1) < self.circles[:, 2] * (1 + 1e-12)
        hole = self.triangles[hit]
        edges: dict[frozenset, tuple[int, int]] = {}
        for t in hole.tolist():
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                key = frozenset(e)
                if key in edges:
                    del edges[key]
                else:
                    edges[key] = e
        n = len(self.points) - 1
        made = [(a, b, n) for a, b in edges.values()]
        self.triangles = np.vstack([self.triangles[~hit], np.array(made)])
        self.circles = np.vstack([self.circles[~hit], np.array([self._circle(*t) for t in made])])
        return n

    def edges(self) -> set[frozenset]:
        t = self.triangles
        return {frozenset(e) for a, b in ((0, 1), (1, 2), (2, 0)) for e in zip(t[:, a].tolist(), t[:, b].tolist(), strict=True)}


def inside(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Ray parity."""
    a, b = ring, np.roll(ring, -1, 0)
    x, y = points[:, :1], points[:, 1:]
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return ((low <= y) & (y < high) & (at > x)).sum(1) % 2 == 1


def _weights(samples: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """(samples, triangles, 3) barycentric weights."""
    a, b, c = corners[:, 0], corners[:, 1], corners[:, 2]
    d = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    p = samples[:, None, :] - a
    v = (p[..., 0] * (c[:, 1] - a[:, 1]) - p[..., 1] * (c[:, 0] - a[:, 0])) / d
    w = (p[..., 1] * (b[:, 0] - a[:, 0]) - p[..., 0] * (b[:, 1] - a[:, 1])) / d
    return np.stack([1 - v - w, v, w], -1)


def _locate(samples: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each sample's first triangle (or -1) and its weights in it, a bounded block of samples at a time."""
    home, weights, step = np.full(len(samples), -1), np.zeros((len(samples), 3)), max(1, BLOCK // len(corners))
    for at in range(0, len(samples), step):
        w = _weights(samples[at : at + step], corners)
        held = (w >= -1e-9).all(2)
        first = held.argmax(1)
        home[at : at + step] = np.where(held.any(1), first, -1)
        weights[at : at + step] = w[np.arange(len(w)), first]
    return home, weights


def _turn(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Twice the signed area of each triangle."""
    a, b = v[t[:, 1]] - v[t[:, 0]], v[t[:, 2]] - v[t[:, 0]]
    return a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]


def triangulate(ring: np.ndarray, samples: np.ndarray, values: np.ndarray, tolerance: float, max_edge: float = math.inf, most: int = 20_000, metres: Sequence[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, triangles wound anticlockwise) of a closed ring's inside.

    values: (samples, surfaces), NaN for no data, which has no error. A triangle whose worst sample is off by more than the tolerance
    of its surface's range (or than its surface's `metres`, where given) takes that sample as a vertex; an edge longer than max_edge is halved. Edges of the ring are kept by
    halving those that the triangulation doesn't hold. More than `most` vertices are an error.
    """
    ring = ring[:-1] if len(ring) > 1 and np.allclose(ring[0], ring[-1]) else ring
    mesh = Delaunay(ring.min(0), ring.max(0))
    loop = [mesh.insert(p) for p in ring]
    with np.errstate(invalid="ignore"):
        span = np.nanmax(values, 0, initial=-np.inf) - np.nanmin(values, 0, initial=np.inf) if len(values) else np.zeros(0)
    limit = np.where(np.isfinite(span), np.maximum(span, 1e-12) * tolerance, np.inf)
    if metres is not None:
        limit = np.asarray(metres, float)
    own: dict[int, np.ndarray] = {}

    def conform() -> None:
        """Halves ring edges until all of them are edges of triangles and short enough."""
        changed = True
        while changed and len(mesh.points) < most:
            changed, held, i = False, mesh.edges(), 0
            while i < len(loop):
                a, b = loop[i], loop[(i + 1) % len(loop)]
                length = float(np.hypot(*(mesh.points[a] - mesh.points[b])))
                if a != b and (frozenset((a, b)) not in held or length > max_edge) and length > 4 * mesh.snap:
                    loop.insert(i + 1, mesh.insert((mesh.points[a] + mesh.points[b]) / 2))
                    changed = True
                    i += 1
                i += 1

    def known(vertex: int) -> np.ndarray:
        """A vertex's values: the nearest sample's."""
        if vertex not in own:
            own[vertex] = values[((samples - mesh.points[vertex]) ** 2).sum(1).argmin()] if len(samples) else np.zeros(values.shape[1])
        return own[vertex]

    conform()
    while True:
        points = np.array(mesh.points)
        t = mesh.triangles[(mesh.triangles > 2).all(1)]
        outline = points[loop]
        t = t[inside(points[t].mean(1), outline)]
        if len(points) >= most:
            raise RuntimeError(f"the tolerance isn't met with {most} vertices; raise `most` or the tolerance")
        fresh = []
        if len(samples) and len(t):
            home, own_w = _locate(samples, points[t])
            at = np.array([[known(v) for v in row] for row in t.tolist()])
            there = np.flatnonzero(home >= 0)
            fitted = np.einsum("sk,skf->sf", own_w[there], at[home[there]])
            off = np.abs(fitted - values[there])
            off = np.where(np.isnan(values[there]), 0.0, np.where(np.isnan(off), np.inf, off)) / limit
            worst = off.max(1, initial=0.0)
            for k in np.unique(home[there]):
                mine = there[home[there] == k]
                score = worst[home[there] == k]
                if score.max() > 1:
                    fresh.append(samples[mine[score.argmax()]])
        sides = points[t] - np.roll(points[t], -1, 1)
        for k in np.flatnonzero(np.hypot(sides[..., 0], sides[..., 1]).max(1, initial=0.0) > max_edge * (1 + 1e-12)):
            e = int(np.hypot(sides[k, :, 0], sides[k, :, 1]).argmax())
            fresh.append((points[t[k, e]] + points[t[k, (e + 1) % 3]]) / 2)
        before = len(mesh.points)
        for p in fresh:
            mesh.insert(p)
        conform()
        if len(mesh.points) == before:
            break
    used, flat = np.unique(t, return_inverse=True)
    t = flat.reshape(t.shape)
    v = points[used]
    turned = _turn(v, t) < 0 if len(t) else np.zeros(0, bool)
    t[turned] = t[turned][:, ::-1]
    return v, t


def adaptive_tins(outlines: DataFrame, samples: DataFrame, surfaces: Sequence[str], tolerance: float = 0.0, max_edge: float = math.inf, metres: Sequence[float] | None = None) -> DataFrame:
    """(basin, tri, corner, x, y, vid) from outlines (basin, n, x, y) and samples (basin, x, y, surfaces)."""

    def one(outline: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        ring = outline.sort_values("n")[["x", "y"]].to_numpy(float)
        v, t = triangulate(ring, own[["x", "y"]].to_numpy(float), own[list(surfaces)].to_numpy(float), tolerance, max_edge, metres=metres)
        flat = t.ravel()
        return pd.DataFrame({"basin": outline["basin"].iloc[0], "tri": np.repeat(np.arange(len(t)), 3), "corner": np.tile(np.arange(3), len(t)), "vid": flat, "x": v[flat, 0], "y": v[flat, 1]})

    schema = f"basin {outlines.schema['basin'].dataType.simpleString()}, tri long, corner int, vid long, x double, y double"
    outlines, samples = (d.toDF(*(f"_{c}" for c in d.columns)).toDF(*d.columns) for d in (outlines, samples))  # samples may come from the outlines
    return outlines.groupBy("basin").cogroup(samples.groupBy("basin")).applyInPandas(one, schema)
