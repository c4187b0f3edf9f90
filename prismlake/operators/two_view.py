"""Two-view geometry: fundamental and essential matrices, relative poses, verification of matches.

Rows are matches of image pairs: img_a, img_b, u1, v1, u2, v2. A pair's matches, of which images have
as many as features at most, meet in one call; pairs are dealt over the cluster. Samples are seeded by
the pair, so that reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples at most, and the chance with which one without outliers is among those drawn.
SAMPLES, CONFIDENCE = 1000, 0.999


def _conditioned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points with mean 0 and mean distance sqrt(2), and the matrix that made them so."""
    mean = x.mean(axis=0)
    s = math.sqrt(2) / max(1e-12, np.linalg.norm(x - mean, axis=1).mean())
    return (x - mean) * s, np.array([[s, 0, -s * mean[0]], [0, s, -s * mean[1]], [0, 0, 1]])


def eight_point(x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """The rank-2 matrix that fits x2' F x1 = 0 best, of norm 1."""
    (a, t1), (b, t2) = _conditioned(x1), _conditioned(x2)
    rows = np.column_stack([b[:, :1] * a, b[:, 0], b[:, 1:] * a, b[:, 1], a, np.ones(len(a))])
    # with nine rows or more the short form has the last vector, and no square as wide as the matches are many
    u, s, vt = np.linalg.svd(np.linalg.svd(rows, full_matrices=len(rows) < 9)[2][-1].reshape(3, 3))
    f = t2.T @ (u * [s[0], s[1], 0]) @ vt @ t1
    return f / np.linalg.norm(f)


def epipolar(f: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """The larger distance of each match's points to the lines of one another."""
    a, b = (np.column_stack([x, np.ones(len(x))]) for x in (x1, x2))
    l2, l1 = a @ f.T, b @ f
    e = np.abs((b * l2).sum(axis=1))
    return np.maximum(e / np.maximum(np.hypot(l2[:, 0], l2[:, 1]), 1e-12), e / np.maximum(np.hypot(l1[:, 0], l1[:, 1]), 1e-12))


def fundamental(x1: np.ndarray, x2: np.ndarray, threshold: float = 1.0, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """(F, inliers); None with fewer than eight matches."""
    if len(x1) < 8:
        return None, np.zeros(len(x1), bool)
    rng, best, need, k = np.random.default_rng(seed), np.zeros(len(x1), bool), SAMPLES, 0
    while k < need:
        sample = rng.choice(len(x1), 8, replace=False)
        inside = epipolar(eight_point(x1[sample], x2[sample]), x1, x2) < threshold
        if inside.sum() > best.sum():
            best = inside
            clean = min(max(inside.mean() ** 8, 1e-12), 1 - 1e-12)
            need = min(SAMPLES, math.ceil(math.log(1 - CONFIDENCE) / math.log(1 - clean)))
        k += 1
    if best.sum() < 8:
        return None, best
    for _ in range(3):  # the fit of all inliers, and its own inliers
        f = eight_point(x1[best], x2[best])
        inside = epipolar(f, x1, x2) < threshold
        if inside.sum() < 8 or (inside == best).all():
            break
        best = inside
    return f, best


def essential(f: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The essential matrix nearest to K' F K: equal singular values, and 0."""
    u, _, vt = np.linalg.svd(k.T @ f @ k)
    return (u * [1, 1, 0]) @ vt


def triangulated(p1: np.ndarray, p2: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """World points of matches, by the smallest singular vector."""
    a = np.stack([x1[:, :1] * p1[2] - p1[0], x1[:, 1:] * p1[2] - p1[1], x2[:, :1] * p2[2] - p2[0], x2[:, 1:] * p2[2] - p2[1]], axis=1)
    v = np.linalg.svd(a)[2][:, -1]
    return v[:, :3] / np.where(np.abs(v[:, 3:]) < 1e-12, 1e-12, v[:, 3:])


def decompose(e: np.ndarray, k: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(R, t of length 1, points): of the four poses that e allows the one with most points ahead of both cameras."""
    u, _, vt = np.linalg.svd(e)
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    w, first, best = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]]), k @ np.eye(3, 4), None
    for r in (u @ w @ vt, u @ w.T @ vt):
        for t in (u[:, 2], -u[:, 2]):
            x = triangulated(first, k @ np.column_stack([r, t]), x1, x2)
            ahead = int(((x[:, 2] > 0) & ((x @ r.T + t)[:, 2] > 0)).sum())
            if best is None or ahead > best[0]:
                best = ahead, r, t, x
    return best[1:]


def reprojection(k: np.ndarray, r: np.ndarray, t: np.ndarray, x: np.ndarray, seen: np.ndarray) -> np.ndarray:
    q = (x @ r.T + t) @ k.T
    return np.linalg.norm(q[:, :2] / q[:, 2:] - seen, axis=1)


def _arrays(table: pa.Table) -> tuple[tuple, np.ndarray, np.ndarray]:
    """(img_a, img_b), and the points of both images in a fixed order."""
    table = table.sort_by([(c, "ascending") for c in ("u1", "v1", "u2", "v2")])
    x = np.column_stack([np.array(table.column(c), float) for c in ("u1", "v1", "u2", "v2")])
    return (table.column("img_a")[0].as_py(), table.column("img_b")[0].as_py()), x[:, :2], x[:, 2:]


def _seed(pair: tuple) -> int:
    return int(pair[0]) * 1_000_003 + int(pair[1]) & 0x7FFFFFFF


def fundamental_matrices(matches: DataFrame, threshold: float = 1.0) -> DataFrame:
    """img_a, img_b, F (9 numbers of norm 1; null below eight matches), n, n_inliers, mean_error: the inliers' mean distance from their lines."""

    def run(table: pa.Table) -> pa.Table:
        pair, x1, x2 = _arrays(table)
        f, inside = fundamental(x1, x2, threshold, _seed(pair))
        error = float(epipolar(f, x1, x2)[inside].mean()) if f is not None else None
        return pa.table({"img_a": pa.array([pair[0]], pa.int64()), "img_b": pa.array([pair[1]], pa.int64()), "F": pa.array([f.ravel().tolist() if f is not None else None], pa.list_(pa.float64())), "n": pa.array([len(x1)], pa.int64()), "n_inliers": pa.array([int(inside.sum())], pa.int64()), "mean_error": pa.array([error], pa.float64())})

    return matches.select("img_a", "img_b", "u1", "v1", "u2", "v2").groupBy("img_a", "img_b").applyInArrow(run, "img_a long, img_b long, F array<double>, n long, n_inliers long, mean_error double")


def verified_matches(matches: DataFrame, threshold: float = 3.0, keep: tuple[str, ...] = (), least: int = 0) -> DataFrame:
    """img_a, img_b, u1, v1, u2, v2, inlier of every match, and what to keep of it (whole numbers): whether it keeps to the pair's epipolar geometry; of pairs with fewer than eight none does. Pairs with fewer matches or inliers than least go."""
    names = ("u1", "v1", "u2", "v2")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (*names, *keep)])
        pair, x1, x2 = _arrays(table)
        inside = fundamental(x1, x2, threshold, _seed(pair))[1] if len(x1) >= least else np.zeros(len(x1), bool)
        if inside.sum() < least:
            table, x1, x2, inside = table[:0], x1[:0], x2[:0], inside[:0]
        same = [pa.array([p] * len(x1), pa.int64()) for p in pair]
        return pa.table([*same, *(table.column(c) for c in keep), *(pa.array(x) for x in (*x1.T, *x2.T)), pa.array(inside)], names=["img_a", "img_b", *keep, *names, "inlier"])

    cols = [F.col(c).cast("double").alias(c) for c in names]
    of = matches.select("img_a", "img_b", *(F.col(c).cast("long").alias(c) for c in keep), *cols)
    return of.groupBy("img_a", "img_b").applyInArrow(run, "img_a long, img_b long, " + "".join(f"{c} long, " for c in keep) + "u1 double, v1 double, u2 double, v2 double, inlier boolean")


def relative_poses(matches: DataFrame, k: tuple[float, ...], threshold: float = 1.0) -> DataFrame:
    """img_a, img_b, R, t (of length 1), n_inliers, mean_error of the second camera against the first: the inliers' mean reprojection error in both views. Null below eight matches."""
    km = np.array(k, float).reshape(3, 3)

    def run(table: pa.Table) -> pa.Table:
        pair, x1, x2 = _arrays(table)
        f, inside = fundamental(x1, x2, threshold, _seed(pair))
        r = t = error = None
        if f is not None:
            a, b = x1[inside], x2[inside]
            r, t, x = decompose(essential(f, km), km, a, b)
            error = float((reprojection(km, np.eye(3), np.zeros(3), x, a).mean() + reprojection(km, r, t, x, b).mean()) / 2)
            r, t = r.ravel().tolist(), t.tolist()
        lists = pa.list_(pa.float64())
        return pa.table({"img_a": pa.array([pair[0]], pa.int64()), "img_b": pa.array([pair[1]], pa.int64()), "R": pa.array([r], lists), "t": pa.array([t], lists), "n_inliers": pa.array([int(inside.sum())], pa.int64()), "mean_error": pa.array([error], pa.float64())})

    return matches.select("img_a", "img_b", "u1", "v1", "u2", "v2").groupBy("img_a", "img_b").applyInArrow(run, "img_a long, img_b long, R array<double>, t array<double>, n_inliers long, mean_error double")
