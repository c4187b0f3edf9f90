"""Bundle adjustment: cameras and points that leave the least squared reprojection error, by damped steps.

Observations lie packed by point, so that a point's observations, one a camera, are in one part. Each
step eliminates the points (Schur complement): a point's 3x3 block is inverted where it lies, and the
cameras' reduced system is solved by conjugate gradients, whose products with the reduced matrix are
sums over the parts by camera. The matrix itself is never formed: no two observations of a point are
paired, and products go from observation to observation by the few numbers that a pixel changes with.
Parts hold points that begin with the same cameras, so that a part has few cameras, and sums by camera
stay small. Then the points follow by back-substitution, again where they lie.

The driver holds what has the size of the cameras: poses, 6x6 blocks and the vectors of the solver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, materialize

#: Observations to a part, and those of a point more.
PART = 20_000
#: Parts to a task as they are made, on average.
PARTS_TOGETHER = 8
#: Cameras at most: their poses and blocks, some 400 bytes each, lie on the driver and go to every task.
MOST_CAMERAS = 1_000_000
#: Squared pixels an observation under which nothing is left to gain.
VANISHES = 1e-12
#: Numbers that wait to be summed by camera, at least.
WAITING = 1_000_000
#: Steps of conjugate gradients at most, and the share of the residual at which they end.
INNER, FORCING = 50, 0.05
LISTS = pa.list_(pa.float64())
PARTS = "own binary, cams binary, pts binary, uv binary, ids binary, xyz binary"
UPPER = np.triu_indices(6)


def turned(w: np.ndarray) -> np.ndarray:
    """Rotations of axis-angle vectors, n x 3 to n x 3 x 3."""
    angle = np.linalg.norm(w, axis=1)[:, None, None]
    x = crossed(w)
    small = angle < 1e-9
    safe = np.where(small, 1.0, angle)
    return np.eye(3) + np.where(small, 1.0, np.sin(safe) / safe) * x + np.where(small, 0.5, (1 - np.cos(safe)) / safe**2) * (x @ x)


def crossed(v: np.ndarray) -> np.ndarray:
    """The matrices whose product is the cross product with v."""
    x, y, z = v.T
    o = np.zeros_like(x)
    return np.stack([o, -z, y, z, o, -x, -y, x, o], axis=1).reshape(-1, 3, 3)


class _Part:
    """A part's observations, sorted by point, under the cameras as they are: arrays are numbers x observations.

    Of the pixel, u changes with the point in camera space by (a, 0, ax) and v by (0, b, by); m is how both change
    with the point itself. A camera turns about its own axes and shifts. Points that aren't ahead of the camera have
    residuals and derivatives of 0.
    """

    def __init__(self, row: dict, cameras: tuple[np.ndarray, np.ndarray], k: tuple) -> None:
        self.own, self.cams, self.pts, self.ids = (np.frombuffer(row[c], kind) for c, kind in (("own", np.int32), ("cams", np.int32), ("pts", np.int32), ("ids", np.int64)))
        self.xyz, self.starts = np.frombuffer(row["xyz"]).reshape(-1, 3), np.searchsorted(self.pts, np.arange(len(self.ids)))
        (u, v), (fx, fy, cx, cy) = np.frombuffer(row["uv"]).reshape(2, -1), k
        r, t, p = self._camera(cameras[0].reshape(-1, 9)), self._camera(cameras[1]), self._point(self.xyz.T)
        self.v = [r[i] * p[0] + r[i + 1] * p[1] + r[i + 2] * p[2] for i in (0, 3, 6)]
        q = [self.v[i] + t[i] for i in range(3)]
        ahead = q[2] > 1e-8
        z = np.where(ahead, q[2], 1.0)
        x, y = q[0] / z, q[1] / z
        self.a, self.b = fx * ahead / z, fy * ahead / z
        self.ax, self.by, self.e = -self.a * x, -self.b * y, [(fx * x + cx - u) * ahead, (fy * y + cy - v) * ahead]
        self.m = self.a * r[:3] + self.ax * r[6:], self.b * r[3:6] + self.by * r[6:]

    def _camera(self, x: np.ndarray) -> np.ndarray:
        """The rows of the observations' cameras."""
        return np.take(np.ascontiguousarray(x[self.own].T), self.cams, axis=1)

    def _point(self, x: np.ndarray) -> np.ndarray:
        return np.take(np.ascontiguousarray(x), self.pts, axis=1)

    def by_point(self, h: list[np.ndarray]) -> np.ndarray:
        """What pixels' changes say of the points."""
        return np.add.reduceat(self.m[0] * h[0] + self.m[1] * h[1], self.starts, axis=1)

    def by_camera(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.bincount(self.cams, x, len(self.own)) for x in rows], axis=1)

    def eliminate(self, damping: float) -> None:
        (m, n), v = self.m, np.empty((len(self.ids), 3, 3))
        for i in range(3):
            for j in range(i, 3):
                v[:, i, j] = v[:, j, i] = np.add.reduceat(m[i] * m[j] + n[i] * n[j], self.starts)
        self.inverse = np.ascontiguousarray(np.linalg.inv(v + np.eye(3) * (damping * v + 1e-12)).transpose(1, 2, 0))
        self.down = -self.by_point(self.e)

    def solved(self, x: np.ndarray) -> np.ndarray:
        return (self.inverse * x).sum(axis=1)

    def with_points(self, s: np.ndarray) -> list[np.ndarray]:
        """How pixels change as points move."""
        s = self._point(s)
        return [m[0] * s[0] + m[1] * s[1] + m[2] * s[2] for m in self.m]

    def with_cameras(self, x: np.ndarray) -> list[np.ndarray]:
        """How pixels change as cameras move by their rows of x."""
        x, v = self._camera(x), self.v
        d = x[1] * v[2] - x[2] * v[1] + x[3], x[2] * v[0] - x[0] * v[2] + x[4], x[0] * v[1] - x[1] * v[0] + x[5]
        return [self.a * d[0] + self.ax * d[2], self.b * d[1] + self.by * d[2]]

    def product(self, x: np.ndarray) -> np.ndarray:
        """What the points take away from the product of the reduced matrix with x, by the part's cameras."""
        h, v = self.with_points(self.solved(self.by_point(self.with_cameras(x)))), self.v
        g = self.a * h[0], self.b * h[1], self.ax * h[0] + self.by * h[1]
        return self.by_camera([v[1] * g[2] - v[2] * g[1], v[2] * g[0] - v[0] * g[2], v[0] * g[1] - v[1] * g[0], *g])

    def step(self, x: np.ndarray) -> np.ndarray:
        return self.solved(self.down - self.by_point(self.with_cameras(x))).T

    def normal(self) -> np.ndarray:
        """Of each camera the upper half of its own block (21), the reduced right side (6), and the same half of what points take away (21)."""
        (v0, v1, v2), a, b, ax, by, o = self.v, self.a, self.b, self.ax, self.by, np.zeros(len(self.cams))
        c, d = (v1 * ax, v2 * a - v0 * ax, -v1 * a, a, o, ax), (v1 * by - v2 * b, -v0 * by, v0 * b, o, b, by)
        (m, n), inverse = self.m, self._point(self.inverse.reshape(9, -1)).reshape(3, 3, -1)
        near, far = ((inverse * x).sum(axis=1) for x in (m, n))
        p, q, s = (m * near).sum(axis=0), (n * near).sum(axis=0), (n * far).sum(axis=0)
        e, f = (x + y for x, y in zip(self.e, self.with_points(self.solved(self.down)), strict=True))
        pairs = list(zip(*UPPER, strict=True))
        own = [c[i] * c[j] + d[i] * d[j] for i, j in pairs]
        right = [-(c[i] * e + d[i] * f) for i in range(6)]
        cp, dp = [c[i] * p + d[i] * q for i in range(6)], [c[i] * q + d[i] * s for i in range(6)]
        return self.by_camera([*own, *right, *(cp[i] * c[j] + dp[i] * d[j] for i, j in pairs)])


def _pack(t: pa.Table) -> pa.RecordBatch:
    t = t.sort_by([("pt_id", "ascending"), ("cam", "ascending"), ("u", "ascending"), ("v", "ascending")])
    ids, first, pts = np.unique(np.array(t.column("pt_id"), np.int64), return_index=True, return_inverse=True)
    own, cams = np.unique(np.array(t.column("cam"), np.int32), return_inverse=True)
    xyz = np.array(t.column("p").combine_chunks().flatten(), float).reshape(-1, 3)[first]
    uv = np.stack([np.array(t.column(c), float) for c in "uv"])
    columns = own, cams.astype(np.int32), pts.astype(np.int32), uv, ids, xyz
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], names=[c.split()[0] for c in PARTS.split(", ")])


def _packed(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows whose points stand together, in parts of whole points with so many rows and those of a point more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) > most:
                t = pa.Table.from_batches(held)
                pt = np.array(t.column("pt_id"), np.int64)
                ends = np.flatnonzero(pt[1:] != pt[:-1]) + 1
                at = np.searchsorted(ends, most)
                if at == len(ends):  # the last point may go on
                    break
                yield _pack(t.slice(0, ends[at]))
                held = t.slice(ends[at]).to_batches()
        if held and sum(map(len, held)):
            yield _pack(pa.Table.from_batches(held))

    return run


class _Total:
    """Sums of rows by camera: arrays, for a task sees every camera in most of its parts."""

    def __init__(self, width: int) -> None:
        self.cams, self.rows, self.width, self.more, self.waiting = np.empty(0, np.int32), np.empty((0, width)), width, [], 0

    def add(self, cams: np.ndarray, rows: np.ndarray) -> None:
        self.more.append((cams, rows))
        self.waiting += len(cams)
        if self.waiting > max(len(self.cams), WAITING // self.width):
            self.settle()

    def settle(self) -> None:
        cams, rows = (np.concatenate(x) for x in zip((self.cams, self.rows), *self.more, strict=True))
        order = np.argsort(cams, kind="stable")
        if len(cams):
            self.cams, first = np.unique(cams[order], return_index=True)
            self.rows = np.add.reduceat(rows[order], first, axis=0)
        self.more, self.waiting = [], 0

    def batch(self) -> pa.RecordBatch:
        self.settle()
        offsets = np.arange(len(self.cams) + 1, dtype=np.int32) * (8 * self.width)
        x = pa.Array.from_buffers(pa.binary(), len(self.cams), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.rows))])
        return pa.RecordBatch.from_arrays([pa.array(self.cams, pa.int32()), x], names=["cam", "x"])


def _summed(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Total(width)
        for batch in batches:
            total.add(np.array(batch.column("cam")), np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(-1, width))
        yield total.batch()

    return run


@dataclass
class Adjusted:
    """img_id, R, t of all cameras; pt_id, p of the points that observations tell of; the squared error after each accepted step, the first before any."""

    cameras: DataFrame
    points: DataFrame
    costs: list[float] = field(default_factory=list)


class _Problem:
    def __init__(self, parts: DataFrame, k: tuple) -> None:
        self.parts, self.k = parts, k
        self.context = parts.sparkSession.sparkContext

    def sums(self, cameras: tuple[np.ndarray, np.ndarray], make: Callable[[_Part], np.ndarray], width: int, *more: np.ndarray) -> np.ndarray:
        """Of every part width numbers for each of its cameras, summed up: cameras x width."""
        sent, k = self.context.broadcast((cameras, *more)), self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, *rest = sent.value
            total = _Total(width)
            for batch in batches:
                for row in batch.to_pylist():
                    part = _Part(row, now, k)
                    total.add(part.own, make(part, *rest).reshape(len(part.own), width))
            yield total.batch()

        rows = self.parts.mapInArrow(run, "cam int, x binary").repartition("cam").mapInArrow(_summed(width), "cam int, x binary")
        found, out = rows.toArrow(), np.zeros((len(cameras[0]), width))  # a row for each camera
        out[np.array(found.column("cam"))] = np.frombuffer(b"".join(found.column("x").to_pylist())).reshape(-1, width)
        sent.unpersist()
        return out

    def cost(self, cameras: tuple[np.ndarray, np.ndarray]) -> float:
        return float(self.sums(cameras, lambda part: part.by_camera([part.e[0] ** 2 + part.e[1] ** 2]), 1).sum())

    def moved(self, cameras: tuple[np.ndarray, np.ndarray], x: np.ndarray, damping: float) -> DataFrame:
        """The parts with their points moved by the step that follows from the cameras'."""
        sent, k = self.context.broadcast((cameras, x)), self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, step = sent.value
            for batch in batches:
                xyz = []
                for row in batch.to_pylist():
                    part = _Part(row, now, k)
                    part.eliminate(damping)
                    xyz.append((part.xyz + part.step(step)).tobytes())
                yield batch.set_column(batch.schema.get_field_index("xyz"), "xyz", pa.array(xyz, pa.binary()))

        return self.parts.mapInArrow(run, PARTS)


def _normal(part: _Part, damping: np.ndarray) -> np.ndarray:
    part.eliminate(float(damping[0]))
    return part.normal()


def _product(part: _Part, damping: np.ndarray, x: np.ndarray) -> np.ndarray:
    part.eliminate(float(damping[0]))
    return part.product(x)


def _whole(upper: np.ndarray) -> np.ndarray:
    out = np.empty((len(upper), 6, 6))
    out[:, *UPPER] = out[:, UPPER[1], UPPER[0]] = upper
    return out


def _solved(problem: _Problem, cameras: tuple[np.ndarray, np.ndarray], free: np.ndarray, damping: float) -> np.ndarray:
    """The cameras' step (n x 6, zeros where they are held), by conjugate gradients with their own blocks as preconditioner."""
    lam = np.array([damping])
    sums = problem.sums(cameras, _normal, 48, lam)
    own, right, taken = _whole(sums[:, :21]), sums[:, 21:27] * free[:, None], _whole(sums[:, 27:])
    own = own + np.eye(6) * (damping * own + 1e-12)
    near = np.linalg.pinv(own - taken, hermitian=True)
    condition = lambda x: np.einsum("nij,nj->ni", near, x) * free[:, None]
    x, rest = np.zeros_like(right), right
    z = condition(rest)
    way, size, end = z, float((rest * z).sum()), FORCING * math.sqrt(float((right**2).sum()))
    for _ in range(min(INNER, 6 * int(free.sum()))):
        if math.sqrt(float((rest**2).sum())) <= end or size <= 0:
            break
        product = (np.einsum("nij,nj->ni", own, way) - problem.sums(cameras, _product, 6, lam, way)) * free[:, None]
        curve = float((way * product).sum())
        if curve <= 0:
            break
        x, rest = x + size / curve * way, rest - size / curve * product
        z = condition(rest)
        size, before = float((rest * z).sum()), size
        way = z + size / before * way
    return x


def bundle_adjust(cameras: DataFrame, points: DataFrame, observations: DataFrame, k: tuple[float, float, float, float], held: list[int] | None = None, rounds: int = 50, tolerance: float = 1e-6, vanishes: float = VANISHES) -> Adjusted:
    """Cameras (img_id, R, t) and points (pt_id, p) adjusted to observations (img_id, pt_id, u, v) under k = fx, fy, cx, cy.

    held: cameras that stay, by default the one of the smallest id; an empty list holds none. Observations
    of unknown cameras or points, or with null pixels, don't count, and points without any stay out. Steps
    end after so many rounds, or when an accepted one lowers the squared error by less than the tolerance's
    share or leaves next to none (vanishes, squared pixels an observation). Errors never grow: a step that would is taken back and damped more.
    """
    spark: SparkSession = cameras.sparkSession
    known = cameras.select(F.col("img_id").cast("long").alias("img_id"), "R", "t").orderBy("img_id").limit(MOST_CAMERAS + 1).toArrow()
    if len(known) > MOST_CAMERAS:
        raise ValueError(f"more than {MOST_CAMERAS} cameras")
    ids = known.column("img_id").to_pylist()
    r, t = (np.array(known.column(c).to_pylist(), float).reshape(len(ids), *shape) for c, shape in (("R", (3, 3)), ("t", (3,))))
    free = ~np.isin(ids, ids[:1] if held is None else held)
    scratch = Scratch(spark)
    index = spark.createDataFrame(pa.table({"img_id": pa.array(ids, pa.int64()), "cam": pa.array(range(len(ids)), pa.int32())}))
    seen = observations.where("u IS NOT NULL AND v IS NOT NULL").select(F.col("img_id").cast("long").alias("img_id"), F.col("pt_id").cast("long").alias("pt_id"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    seen = seen.join(index, "img_id").join(points.select(F.col("pt_id").cast("long").alias("pt_id"), "p"), "pt_id").select("cam", "pt_id", "p", "u", "v")
    seen = scratch.table(seen.withColumn("first", F.min("cam").over(Window.partitionBy("pt_id"))), "observed")
    count = seen.count()
    # a range of first cameras, of whole points, is some parts
    ranges = seen.repartitionByRange(max(1, -(-count // (PARTS_TOGETHER * PART))), "first", "pt_id").sortWithinPartitions("first", "pt_id").select("cam", "pt_id", "p", "u", "v")
    packed = ranges.mapInArrow(_packed(PART), PARTS)
    problem, now, damping = _Problem(scratch.table(packed, "parts"), k), (r, t), 1e-3
    costs = [problem.cost(now)]
    for _ in range(rounds if costs[0] > vanishes * count else 0):
        x = _solved(problem, now, free, damping)
        next_parts = scratch.table(problem.moved(now, x, damping), "parts")
        turn = turned(x[:, :3])
        after = turn @ now[0], now[1] + x[:, 3:]
        moved = _Problem(next_parts, k)
        cost = moved.cost(after)
        if cost < costs[-1]:
            gain = (costs[-1] - cost) / costs[-1]
            problem, now, damping = moved, after, max(damping / 10, 1e-12)
            costs.append(cost)
            if gain < tolerance or cost <= vanishes * count:
                break
        else:
            damping *= 10
            if damping > 1e8:
                break
    table = pa.table({"img_id": pa.array(ids, pa.int64()), "R": pa.array(now[0].reshape(len(ids), 9).tolist(), LISTS), "t": pa.array(now[1].tolist(), LISTS)})
    adjusted = Adjusted(spark.createDataFrame(table), materialize(_points(problem.parts), "points"), costs)
    scratch.clear()
    return adjusted


def _points(parts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                xyz = np.frombuffer(row["xyz"]).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["ids"], np.int64)), pa.array(xyz.tolist(), LISTS)], names=["pt_id", "p"])

    return parts.select("ids", "xyz").mapInArrow(run, "pt_id long, p array<double>")
