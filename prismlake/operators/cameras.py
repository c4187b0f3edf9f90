"""Rotations, rigid transforms and the pinhole camera, as expressions over camera and point columns.

A camera maps world to camera space by x_cam = R x + t, looks along +z and has no half-pixel offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linear import add, dot, mat_mul, mat_t_vec, mat_vec, norm, scale, sub, vec

FLIP = (1.0, -1.0, -1.0)


def rotation(axis: str, degrees: Column) -> Column:
    """Right-handed rotation about x, y or z."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return {"x": vec(1, 0, 0, 0, c, -s, 0, s, c), "y": vec(c, 0, s, 0, 1, 0, -s, 0, c), "z": vec(c, -s, 0, s, c, 0, 0, 0, 1)}[axis]


def world_to_camera(p: Column, r: Column, t: Column) -> Column:
    return add(mat_vec(r, p), t)


def camera_to_world(p: Column, r: Column, t: Column) -> Column:
    return mat_t_vec(r, sub(p, t))


def center(r: Column, t: Column) -> Column:
    return scale(mat_t_vec(r, t), -1.0)


def pose_matrix(r: Column, t: Column) -> Column:
    """Camera-to-world as 16 numbers."""
    c = center(r, t)
    return vec(r[0], r[3], r[6], c[0], r[1], r[4], r[7], c[1], r[2], r[5], r[8], c[2], 0, 0, 0, 1)


def pose_parts(m: Column) -> tuple[Column, Column]:
    """(R, t) of a camera-to-world matrix."""
    r = vec(m[0], m[4], m[8], m[1], m[5], m[9], m[2], m[6], m[10])
    return r, scale(mat_vec(r, vec(m[3], m[7], m[11])), -1.0)


def flip_convention(r: Column, t: Column) -> tuple[Column, Column]:
    """Between the y-down, z-forward and the y-up, z-backward camera: its own inverse."""
    return vec(*(r[3 * i + j] * FLIP[i] for i in range(3) for j in range(3))), vec(*(t[i] * FLIP[i] for i in range(3)))


def from_backward_pose(m: Column) -> tuple[Column, Column]:
    """(R, t), z forward, of a camera-to-world matrix whose camera looks along -z."""
    return pose_parts(vec(*(m[4 * i + j] * (FLIP[j] if j < 3 and i < 3 else 1.0) for i in range(4) for j in range(4))))


def skew(v: Column) -> Column:
    return vec(0, -v[2], v[1], v[2], 0, -v[0], -v[1], v[0], 0)


def homogeneous(v: Column) -> Column:
    return F.array_append(v, F.lit(1.0))


def dehomogeneous(v: Column) -> Column:
    last = F.element_at(v, -1)
    return F.transform(F.slice(v, F.lit(1), F.size(v) - 1), lambda x: x / last)


def intrinsics(fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    return vec(fx, 0, cx, 0, fy, cy, 0, 0, 1)


def intrinsic_parts(k: Column) -> tuple[Column, Column, Column, Column]:
    """fx, fy, cx, cy of a matrix."""
    return k[0], k[4], k[2], k[5]


def intrinsics_from_fov(width: Column, height: Column, degrees: Column | float = 60.0) -> Column:
    f = width / 2 / F.tan(F.radians(degrees if isinstance(degrees, Column) else F.lit(degrees)) / 2)
    return intrinsics(f, f, width / 2, height / 2)


def projection_matrix(k: Column, r: Column, t: Column) -> Column:
    """K [R t], 12 numbers."""
    m, v = mat_mul(k, r), mat_vec(k, t)
    return vec(*(x for i in range(3) for x in (m[3 * i], m[3 * i + 1], m[3 * i + 2], v[i])))


def distort(x: Column, y: Column, d: Column) -> tuple[Column, Column]:
    """Radial (k1, k2, k3) and tangential (p1, p2) lens distortion, d = k1, k2, p1, p2, k3."""
    r2 = x * x + y * y
    radial = 1 + r2 * (d[0] + r2 * (d[1] + r2 * d[4]))
    return x * radial + 2 * d[2] * x * y + d[3] * (r2 + 2 * x * x), y * radial + d[2] * (r2 + 2 * y * y) + 2 * d[3] * x * y


def project(p: Column, k: Column, distortion: Column | None = None) -> tuple[Column, Column]:
    """Pixel of a point in camera space; null where the depth isn't positive."""
    front = F.when(p[2] > 0, p[2])
    x, y = p[0] / front, p[1] / front
    if distortion is not None:
        x, y = distort(x, y, distortion)
    return k[0] * x + k[2], k[4] * y + k[5]


def project_world(rows: DataFrame, k: Column, p: str = "p", camera: str = "camera") -> DataFrame:
    """Adds u, v: the pixel of a world point under a camera of six numbers, axis-angle vector and shift; null where it isn't ahead."""
    d = rows.withColumn("_w", F.slice(camera, 1, 3)).withColumn("_t", F.slice(camera, 4, 3))
    d = d.withColumn("_R", axis_angle_matrix(F.col("_w"))).withColumn("_q", world_to_camera(F.col(p), F.col("_R"), F.col("_t")))
    u, v = project(F.col("_q"), k)
    return d.withColumns({"u": u, "v": v}).drop("_w", "_t", "_R", "_q")


def backproject(u: Column, v: Column, depth: Column, k: Column, r: Column, t: Column) -> Column:
    """World point of a pixel at a depth along z."""
    return camera_to_world(vec((u - k[2]) / k[0] * depth, (v - k[5]) / k[4] * depth, depth), r, t)


def undistort(u: Column, v: Column, k: Column, d: Column, rounds: int = 5) -> tuple[Column, Column]:
    """Normalised coordinates of a distorted pixel by fixed-point steps.

    Steps nest as expressions, and each names the last result more than once: the steps run inside an
    array so that the plan grows with their number, not with its exponential.
    """
    x0, y0 = (u - k[2]) / k[0], (v - k[5]) / k[4]

    def step(p: Column, _: Column) -> Column:
        r2 = p[0] * p[0] + p[1] * p[1]
        radial = 1 + r2 * (d[0] + r2 * (d[1] + r2 * d[4]))
        return vec((x0 - (2 * d[2] * p[0] * p[1] + d[3] * (r2 + 2 * p[0] * p[0]))) / radial, (y0 - (d[2] * (r2 + 2 * p[1] * p[1]) + 2 * d[3] * p[0] * p[1])) / radial)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), vec(x0, y0), step)
    return out[0], out[1]


def ray_point(u: Column, v: Column, distance: Column, k: Column, d: Column) -> Column:
    """Camera-space point at a distance along a pixel's unit ray."""
    x, y = undistort(u, v, k, d)
    return scale(vec(x, y, 1), distance / F.sqrt(x * x + y * y + 1))


def in_frustum(p: Column, k: Column, width: Column, height: Column, near: float = 0.1, far: float = 100.0) -> Column:
    u, v = project(p, k)
    return F.coalesce(p[2].between(near, far) & (u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def axis_angle_matrix(w: Column) -> Column:
    """Rotation of an axis-angle vector; first order where the angle vanishes."""
    a = norm(w)
    small = a < 1e-9
    s, c = F.when(small, 1.0).otherwise(F.sin(a) / F.nullif(a, F.lit(0.0))), F.when(small, 0.5).otherwise((1 - F.cos(a)) / F.nullif(a * a, F.lit(0.0)))
    x, y, z = w[0], w[1], w[2]
    return vec(1 - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y, c * x * y + s * z, 1 - c * (x * x + z * z), c * y * z - s * x, c * x * z - s * y, c * y * z + s * x, 1 - c * (x * x + y * y))


def matrix_axis_angle(r: Column) -> Column:
    """Axis-angle vector of a rotation; near a half turn the axis comes from the diagonal."""
    a = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (r[0] + r[4] + r[8] - 1) / 2)))
    axis = vec(r[7] - r[5], r[2] - r[6], r[3] - r[1])
    half = [F.sqrt(F.greatest(F.lit(0.0), (r[4 * k] + 1) / 2)) for k in range(3)]
    sign_y = F.when((half[0] > 1e-6) & (r[1] + r[3] < 0), -1.0).otherwise(1.0)
    sign_z = F.when((half[0] > 1e-6) & (r[2] + r[6] < 0), -1.0).when((half[0] <= 1e-6) & (r[5] + r[7] < 0), -1.0).otherwise(1.0)
    turn = scale(vec(half[0], half[1] * sign_y, half[2] * sign_z), a)
    return F.when(a < 1e-9, scale(axis, 0.5)).when(F.sin(a) < 1e-6, turn).otherwise(scale(axis, a / (2 * F.nullif(F.sin(a), F.lit(0.0)))))


def quaternion(r: Column) -> Column:
    """(w, x, y, z) of a rotation, w not negative, by the largest of its four squares."""
    tr = r[0] + r[4] + r[8]
    w = F.sqrt(F.greatest(F.lit(0.0), 1 + tr)) / 2
    x, y, z = (F.sqrt(F.greatest(F.lit(0.0), 1 + 2 * r[4 * k] - tr)) / 2 for k in range(3))
    sign = lambda c: F.when(c < 0, -1.0).otherwise(1.0)
    plain = vec(w, x * sign(r[7] - r[5]), y * sign(r[2] - r[6]), z * sign(r[3] - r[1]))
    return F.when(w > 1e-4, plain).when((x >= y) & (x >= z), vec(w, x, y * sign(r[1] + r[3]), z * sign(r[2] + r[6]))).when(y >= z, vec(w, x * sign(r[1] + r[3]), y, z * sign(r[5] + r[7]))).otherwise(vec(w, x * sign(r[2] + r[6]), y * sign(r[5] + r[7]), z))


def quaternion_matrix(q: Column) -> Column:
    w, x, y, z = q[0], q[1], q[2], q[3]
    return vec(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))


def slerp(a: Column, b: Column, share: Column) -> Column:
    """Between unit quaternions, the short way; linear where they nearly agree."""
    d = dot(a, b, 4)
    sign, d = F.when(d < 0, -1.0).otherwise(1.0), F.least(F.abs(d), F.lit(1.0))
    angle = F.acos(d)
    wide = F.nullif(F.sin(angle), F.lit(0.0))
    fa = F.when(d > 0.9995, 1 - share).otherwise(F.sin((1 - share) * angle) / wide)
    fb = F.when(d > 0.9995, share).otherwise(F.sin(share * angle) / wide)
    q = F.array(*(fa * a[k] + fb * sign * b[k] for k in range(4)))
    size = F.sqrt(dot(q, q, 4))
    return F.array(*(q[k] / size for k in range(4)))


def rotation_angle(a: Column, b: Column) -> Column:
    """Degrees between two rotations."""
    trace = sum((a[k] * b[k] for k in range(1, 9)), a[0] * b[0])
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def plane_homography(k_to: Column, k_from: Column, r: Column, t: Column, normal: Column, depth: Column) -> Column:
    """Pixel map between two views of a plane at a depth (1e-4 at least): K' (R - t n / d) K^-1."""
    d = F.greatest(depth, F.lit(1e-4))
    inner = [[r[3 * i + j] - t[i] * normal[j] / d for j in range(3)] for i in range(3)]
    # the intrinsics' zeros are left out: general products would repeat every term nine times
    rows = [[k_to[0] * inner[0][j] + k_to[2] * inner[2][j] for j in range(3)], [k_to[4] * inner[1][j] + k_to[5] * inner[2][j] for j in range(3)], inner[2]]
    return vec(*(x for m in rows for x in (m[0] / k_from[0], m[1] / k_from[4], m[2] - m[0] * k_from[2] / k_from[0] - m[1] * k_from[5] / k_from[4])))


def normalizations(points: DataFrame, *axes: str, by: tuple[str, ...] = ()) -> DataFrame:
    """T of each group of by: the matrix, axes + 1 rows and columns, that makes homogeneous points what normalize_points() makes them."""
    n = len(axes)
    mean = points.groupBy(*by).agg(F.struct(*(F.avg(a).alias(a) for a in axes)).alias("_m"))
    d = points.join(mean, list(by)) if by else points.crossJoin(F.broadcast(mean))
    away = F.sqrt(sum(((F.col(a) - F.col(f"_m.{a}")) ** 2 for a in axes[1:]), (F.col(axes[0]) - F.col(f"_m.{axes[0]}")) ** 2))
    one = d.groupBy(*by).agg((F.sqrt(F.lit(float(n))) / (F.avg(away) + 1e-8)).alias("_s"), F.first("_m").alias("_m"))
    rows = [[F.col("_s") if i == j else F.lit(0.0) for j in range(n)] + [-F.col("_s") * F.col(f"_m.{axes[i]}")] for i in range(n)]
    return one.select(*by, vec(*(x for r in [*rows, [F.lit(0.0)] * n + [F.lit(1.0)]] for x in r)).alias("T"))


def normalize_points(points: DataFrame, *axes: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds n_<axis>, centred on the mean and scaled to a mean distance of sqrt(axes), of each group of by.

    Two aggregates and a broadcast of one row a group; the second needs the centre of the first.
    """
    keys = list(by)
    mean = points.groupBy(*keys).agg(*(F.avg(a).alias(f"mean_{a}") for a in axes))
    centred = points.join(mean, keys) if keys else points.crossJoin(F.broadcast(mean))
    centred = centred.withColumns({f"c_{a}": F.col(a) - F.col(f"mean_{a}") for a in axes})
    spread = centred.groupBy(*keys).agg(F.avg(F.sqrt(sum((F.col(f"c_{a}") * F.col(f"c_{a}") for a in axes[1:]), F.col(f"c_{axes[0]}") * F.col(f"c_{axes[0]}")))).alias("spread"))
    out = centred.join(spread, keys) if keys else centred.crossJoin(F.broadcast(spread))
    return out.select(*points.columns, *((F.col(f"c_{a}") * F.sqrt(F.lit(float(len(axes)))) / (F.col("spread") + 1e-8)).alias(f"n_{a}") for a in axes))


