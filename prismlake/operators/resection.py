"""Camera poses from points and their pixels: seeded samples of three, consensus, and refinement.

Rows are correspondences (img_id, p, u, v). An image's correspondences, of which it has as many as
features at most, meet in one call; images are dealt over the cluster. Samples are seeded by the image,
so that reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bundle import LISTS, turned

#: Samples at most, the chance with which one without outliers is among those drawn, and steps of a refinement at most.
SAMPLES, CONFIDENCE, STEPS = 1000, 0.999, 30
#: Samples that are solved together, errors of theirs at once, and squared pixels a point under which nothing is left to gain.
TOGETHER, MOST_ERRORS, VANISHES = 16, 1_000_000, 1e-20

Camera = tuple[float, float, float, float]


def bearings(uv: np.ndarray, k: Camera) -> np.ndarray:
    """Unit rays of pixels in camera space."""
    d = np.column_stack([(uv[:, 0] - k[2]) / k[0], (uv[:, 1] - k[3]) / k[1], np.ones(len(uv))])
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def rigid(start: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rotations and shifts that take sets of points (b x n x 3) to sets of points with least squares."""
    a, b = start.mean(axis=1), goal.mean(axis=1)
    u, _, vt = np.linalg.svd((goal - b[:, None]).transpose(0, 2, 1) @ (start - a[:, None]))
    sign = np.sign(np.linalg.det(u @ vt))
    u[:, :, 2] *= np.where(sign == 0, 1.0, sign)[:, None]
    r = u @ vt
    return r, b - np.einsum("bij,bj->bi", r, a)


def from_three(p: np.ndarray, rays: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The poses, four at most, that see three points along three rays."""
    _, r, t = from_threes(p[None], rays[None])
    return list(zip(r, t, strict=True))


def from_threes(p: np.ndarray, rays: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sample, R, t) of the poses, four at most of each sample, that see three points along three rays (both b x 3 x 3).

    With distances s1, u s1 and v s1 the law of cosines, taken for each two of them, leaves a quartic in v.
    """
    a2, b2, c2 = (((p[:, i] - p[:, j]) ** 2).sum(axis=1) for i, j in ((1, 2), (0, 2), (0, 1)))
    of = np.flatnonzero(np.minimum(np.minimum(a2, b2), c2) >= 1e-18)
    a2, b2, c2, d = a2[of], b2[of], c2[of], rays[of]
    ca, cb, cc = ((d[:, i] * d[:, j]).sum(axis=1) for i, j in ((1, 2), (0, 2), (0, 1)))
    q, s = (a2 - c2) / b2, (a2 + c2) / b2
    quartic = np.stack(
        [
            (q - 1) ** 2 - 4 * c2 / b2 * ca**2,
            4 * (q * (1 - q) * cb - (1 - s) * ca * cc + 2 * c2 / b2 * ca**2 * cb),
            2 * (q**2 - 1 + 2 * q**2 * cb**2 + 2 * (b2 - c2) / b2 * ca**2 - 4 * s * ca * cb * cc + 2 * (b2 - a2) / b2 * cc**2),
            4 * (-q * (1 + q) * cb + 2 * a2 / b2 * cc**2 * cb - (1 - s) * ca * cc),
            (1 + q) ** 2 - 4 * a2 / b2 * cc**2,
        ],
        axis=1,
    )
    flat = np.abs(quartic[:, 0]) <= 1e-14 * np.abs(quartic).max(axis=1, initial=0)
    companion = np.zeros((len(of), 4, 4))
    companion[:, [1, 2, 3], [0, 1, 2]] = 1
    companion[:, 0] = -quartic[:, 1:] / np.where(flat, 1.0, quartic[:, 0])[:, None]
    v = np.linalg.eigvals(companion).astype(complex)
    for i in np.flatnonzero(flat):  # of a lower degree
        roots = np.roots(quartic[i])
        v[i] = np.append(roots, [-1.0] * (4 - len(roots)))
    real = (np.abs(v.imag) <= 1e-6) & (v.real > 0)
    at, v = np.nonzero(real)[0], v.real[real]
    below = 2 * (cc[at] - v * ca[at])
    fine = np.abs(below) >= 1e-12
    at, v, below = at[fine], v[fine], below[fine]
    u = ((q[at] - 1) * v * v - 2 * q[at] * cb[at] * v + 1 + q[at]) / below
    size = 1 + v * v - 2 * v * cb[at]
    fine = (u > 0) & (size > 0)
    at, u, v, size = at[fine], u[fine], v[fine], size[fine]
    far = np.sqrt(b2[at] / size)[:, None] * np.stack([np.ones_like(u), u, v], axis=1)
    return of[at], *rigid(p[of[at]], far[:, :, None] * d[at])


def errors(r: np.ndarray, t: np.ndarray, p: np.ndarray, uv: np.ndarray, k: Camera) -> np.ndarray:
    """Pixel distances under a pose or each of several; infinite for points that aren't ahead."""
    q = p @ np.swapaxes(r, -1, -2) + t[..., None, :]
    ahead = q[..., 2] > 1e-8
    z = np.where(ahead, q[..., 2], 1.0)
    e = np.hypot(k[0] * q[..., 0] / z + k[2] - uv[..., 0], k[1] * q[..., 1] / z + k[3] - uv[..., 1])
    return np.where(ahead, e, np.inf)


def _equations(r: np.ndarray, t: np.ndarray, p: np.ndarray, uv: np.ndarray, k: Camera) -> tuple[np.ndarray, np.ndarray, bool]:
    """Residuals (2n) of one camera, how they change with its turn and shift (2n x 6), both 0 for points that aren't ahead, and whether all are."""
    v = p @ r.T
    q = v + t
    ahead = q[:, 2] > 1e-8
    z = np.where(ahead, q[:, 2], 1.0)
    x, y = q[:, 0] / z, q[:, 1] / z
    a, b = k[0] * ahead / z, k[1] * ahead / z
    n, j = len(p), np.zeros((6, 2 * len(p)))
    j[0, :n], j[1, :n], j[2, :n], j[3, :n], j[5, :n] = -v[:, 1] * a * x, v[:, 2] * a + v[:, 0] * a * x, -v[:, 1] * a, a, -a * x
    j[0, n:], j[1, n:], j[2, n:], j[4, n:], j[5, n:] = -v[:, 1] * b * y - v[:, 2] * b, v[:, 0] * b * y, v[:, 0] * b, b, -b * y
    e = np.concatenate([(k[0] * x + k[2] - uv[:, 0]) * ahead, (k[1] * y + k[3] - uv[:, 1]) * ahead])
    return e, j.T, bool(ahead.all())


def refined(r: np.ndarray, t: np.ndarray, p: np.ndarray, uv: np.ndarray, k: Camera) -> tuple[np.ndarray, np.ndarray]:
    """The pose of the least squared error near a pose, by damped steps that never raise it."""
    damping = 1e-4
    e, j, ahead = _equations(r, t, p, uv, k)
    cost = float(e @ e)
    for _ in range(STEPS):
        if cost <= VANISHES * len(p):
            break
        m, down = j.T @ j, -(j.T @ e)
        step = np.linalg.lstsq(m + np.diag(damping * np.diag(m) + 1e-12), down, rcond=None)[0]
        r2, t2 = turned(step[None, :3])[0] @ r, t + step[3:]
        e2, j2, ahead2 = _equations(r2, t2, p, uv, k)
        cost2 = float(e2 @ e2)
        if (ahead2 or not ahead) and cost2 <= cost:
            gain, r, t, e, j, ahead, cost, damping = cost - cost2, r2, t2, e2, j2, ahead2, cost2, damping / 10
            if gain <= 1e-12 * max(cost, 1e-12):
                break
        else:
            damping *= 10
            if damping > 1e8:
                break
    return r, t


def resected(p: np.ndarray, uv: np.ndarray, k: Camera, threshold: float, seed: int, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray]:
    """(R, t, inliers) of the pose with most points within the threshold, refined on them; None below four points or inliers."""
    none = None, None, np.zeros(len(p), bool)
    if len(p) < 4:
        return none
    rays, rng, best, need, i = bearings(uv, k), np.random.default_rng(seed), None, SAMPLES, 0

    def better(r: np.ndarray, t: np.ndarray) -> None:
        nonlocal best, need
        away = errors(r, t, p, uv, k)
        within = away < threshold
        for at, (e, inside) in enumerate(zip(away, within, strict=True)):
            score = int(inside.sum()), -float(e[inside].sum())
            if best is None or score > best[0]:
                best = score, (r[at], t[at]), inside
                clean = min(max(inside.mean() ** 4, 1e-12), 1 - 1e-12)
                need = min(SAMPLES, math.ceil(math.log(1 - CONFIDENCE) / math.log(1 - clean)))

    if start is not None:
        better(start[0][None], start[1][None])
    while i < need:
        draw = max(1, min(TOGETHER, need - i, MOST_ERRORS // len(p)))
        sample = np.stack([rng.choice(len(p), 4, replace=False) for _ in range(draw)])
        of, r, t = from_threes(p[sample[:, :3]], rays[sample[:, :3]])
        if len(of):  # the fourth tells them apart
            fourth = errors(r, t, p[sample[of, 3:]], uv[sample[of, 3:]], k)[:, 0]
            order = np.lexsort((fourth, of))
            first = order[np.unique(of[order], return_index=True)[1]]
            better(r[first], t[first])
        i += draw
    if best is None or best[0][0] < 4:
        return none
    _, (r, t), inside = best
    for _ in range(3):  # the fit of all inliers, and its own inliers
        r, t = refined(r, t, p[inside], uv[inside], k)
        again = errors(r, t, p, uv, k) < threshold
        if again.sum() < 4 or (again == inside).all():
            break
        inside = again
    return r, t, inside


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Points and pixels in a fixed order."""
    p = np.array(table.column("p").combine_chunks().flatten(), float).reshape(-1, 3)
    uv = np.column_stack([np.array(table.column(c), float) for c in "uv"])
    order = np.lexsort((p[:, 2], p[:, 1], p[:, 0], uv[:, 1], uv[:, 0]))
    return p[order], uv[order]


POSES = "img_id long, R array<double>, t array<double>, n long, n_inliers long, error double"


def _row(img: int, r: np.ndarray | None, t: np.ndarray | None, n: int, inliers: int, error: float | None) -> pa.Table:
    return pa.table({"img_id": pa.array([img], pa.int64()), "R": pa.array([None if r is None else r.ravel().tolist()], LISTS), "t": pa.array([None if t is None else t.tolist()], LISTS), "n": pa.array([n], pa.int64()), "n_inliers": pa.array([inliers], pa.int64()), "error": pa.array([error], pa.float64())})


def _complete(seen: DataFrame) -> DataFrame:
    return seen.where("p IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL")


def poses_from_points(seen: DataFrame, k: Camera, threshold: float = 4.0, start: DataFrame | None = None) -> DataFrame:
    """img_id, R, t, n, n_inliers, error of each image of correspondences (img_id, p, u, v): the inliers' mean pixel distance.

    start: poses (img_id, R, t) that are asked first. R and t are null where there are fewer than four
    correspondences or no four of them agree; correspondences with nulls don't count.
    """

    def run(key: tuple, table: pa.Table, first: pa.Table | None = None) -> pa.Table:
        img, (p, uv), pose = int(key[0].as_py()), _sorted(table), None
        if first is not None and len(first):
            pose = np.array(first.column("R")[0].as_py()).reshape(3, 3), np.array(first.column("t")[0].as_py())
        r, t, inside = resected(p, uv, k, threshold, img & 0x7FFFFFFF, pose)
        error = float(errors(r, t, p, uv, k)[inside].mean()) if r is not None else None
        return _row(img, r, t, len(p), int(inside.sum()), error)

    groups = _complete(seen).select("img_id", "p", "u", "v").groupBy("img_id")
    if start is None:
        return groups.applyInArrow(lambda key, table: run(key, table), POSES)
    known = start.where("R IS NOT NULL AND t IS NOT NULL").select("img_id", "R", "t").groupBy("img_id")
    return groups.cogroup(known).applyInArrow(lambda key, table, first: run(key, table, first) if len(table) else _row(0, None, None, 0, 0, None).slice(0, 0), POSES)


def refined_poses(seen: DataFrame, cameras: DataFrame, k: Camera) -> DataFrame:
    """img_id, R, t, n, n_inliers, error: poses (img_id, R, t) refined on all their correspondences; those without any stay as they are, with a null error."""

    def run(key: tuple, table: pa.Table, first: pa.Table) -> pa.Table:
        if not len(first):
            return _row(0, None, None, 0, 0, None).slice(0, 0)
        img, r, t = int(key[0].as_py()), np.array(first.column("R")[0].as_py()).reshape(3, 3), np.array(first.column("t")[0].as_py())
        if not len(table):
            return _row(img, r, t, 0, 0, None)
        p, uv = _sorted(table)
        r, t = refined(r, t, p, uv, k)
        return _row(img, r, t, len(p), len(p), float(errors(r, t, p, uv, k).mean()))

    return _complete(seen).select("img_id", "p", "u", "v").groupBy("img_id").cogroup(cameras.select("img_id", "R", "t").groupBy("img_id")).applyInArrow(run, POSES)


def best_poses(*tries: DataFrame) -> DataFrame:
    """Of several results for the same images each image's with the least error; images that none could place keep nulls."""
    rows = tries[0]
    for d in tries[1:]:
        rows = rows.unionByName(d)
    rest = [c for c in rows.columns if c != "img_id"]
    best = rows.groupBy("img_id").agg(F.min_by(F.struct(*rest), F.struct(F.col("R").isNull(), F.coalesce("error", F.lit(float("inf"))))).alias("x"))
    return best.select("img_id", "x.*")
