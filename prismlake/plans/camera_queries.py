"""Queries of the camera and transform operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linear import det, mat_mul, norm, tidy, vec
from ..operators import cameras as C
from ..session import table
from .fixtures import CAMERAS, CX, CY, FOCAL, HEIGHT, OBSERVATIONS, POINTS, SEEN, WIDTH, cameras, observations, points, with_
from .registry import register

def k(focal: float = FOCAL, cx: float = CX, cy: float = CY) -> Column:
    return vec(focal, 0, cx, 0, focal, cy, 0, 0, 1)


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with their camera and point: points are met first, so that no row travels with its camera."""
    return observations(spark, sf_dir).join(points(spark, sf_dir), "pt_id").join(cameras(spark, sf_dir), F.col("cam_id") == F.col("img_id"))


@register(
    "c1_rotation_matrices",
    """SELECT s_suppkey AS img_id, round(cos(a), 6) + 0.0 AS x_cos, round(sin(a), 6) + 0.0 AS y_sin, round(-sin(a), 6) + 0.0 AS z_minus_sin, 1.0::DOUBLE AS det_xyz
FROM (SELECT s_suppkey, radians((s_suppkey * 7 % 360)::DOUBLE) AS a FROM supplier)""",
)
def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("s_suppkey") * 7 % 360).cast("double")
    d = table(spark, sf_dir, "supplier").select("s_suppkey", *(C.rotation(axis, a).alias(axis) for axis in "xyz"))
    d = d.withColumn("xy", mat_mul(F.col("x"), F.col("y")))
    d = d.withColumn("xyz", mat_mul(F.col("xy"), F.col("z")))
    return d.select(F.col("s_suppkey").alias("img_id"), tidy(F.col("x")[4]).alias("x_cos"), tidy(F.col("y")[2]).alias("y_sin"), tidy(F.col("z")[1]).alias("z_minus_sin"), tidy(det(F.col("xyz"))).alias("det_xyz"))


@register(
    "c4_world_camera_round_trip",
    with_(CAMERAS, POINTS, OBSERVATIONS, SEEN) + "SELECT cam_id, count(*)::BIGINT AS n, round(avg(xc), 5) + 0.0 AS mean_x, round(avg(yc), 5) + 0.0 AS mean_y, round(avg(zc), 5) + 0.0 AS mean_z, round(avg(x) + 1e-7, 5) + 0.0 AS back_x, round(avg(z) + 1e-7, 5) + 0.0 AS back_z FROM seen JOIN points USING (pt_id) GROUP BY cam_id",
)
def world_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = seen(spark, sf_dir).withColumn("q", C.world_to_camera(F.col("p"), F.col("R"), F.col("t")))
    back = C.camera_to_world(F.col("q"), F.col("R"), F.col("t"))
    return d.groupBy("cam_id").agg(F.count("*").alias("n"), *(tidy(F.avg(F.col("q")[i]), 5).alias(f"mean_{a}") for i, a in enumerate("xyz")), *(tidy(F.avg(back[i]) + 1e-7, 5).alias(f"back_{a}") for i, a in ((0, "x"), (2, "z"))))


@register("c19_camera_center", with_(CAMERAS) + "SELECT img_id, round(c0, 6) + 0.0 AS cx, round(c1, 6) + 0.0 AS cy, round(c2, 6) + 0.0 AS cz, round(r5, 6) + 0.0 AS r5, round(r6, 6) + 0.0 AS r6, round(t1, 6) + 0.0 AS t1 FROM centers JOIN cameras USING (img_id)")
def camera_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cameras(spark, sf_dir).withColumn("c", C.center(F.col("R"), F.col("t"))).withColumn("m", C.pose_matrix(F.col("R"), F.col("t")))
    r, t = C.pose_parts(F.col("m"))
    d = d.withColumns({"back_r": r, "s": t})
    return d.select("img_id", *(tidy(F.col("c")[i]).alias(f"c{a}") for i, a in enumerate("xyz")), tidy(F.col("back_r")[5]).alias("r5"), tidy(F.col("back_r")[6]).alias("r6"), tidy(F.col("s")[1]).alias("t1"))


@register(
    "c8_normalize_points",
    """WITH m AS (SELECT l_suppkey, avg(l_quantity) AS mx, avg(l_extendedprice / 1000) AS my FROM lineitem GROUP BY 1),
c AS (SELECT l_suppkey, l_quantity - mx AS x, l_extendedprice / 1000 - my AS y FROM lineitem JOIN m USING (l_suppkey)),
s AS (SELECT l_suppkey, avg(sqrt(x * x + y * y)) AS spread FROM c GROUP BY 1)
SELECT l_suppkey AS cam_id, count(*)::BIGINT AS n, round(sum(abs(x * sqrt(2.0) / (spread + 1e-8))), 3) + 0.0 AS sum_x, round(avg(sqrt(x * x + y * y) * sqrt(2.0) / (spread + 1e-8)), 6) + 0.0 AS mean_distance FROM c JOIN s USING (l_suppkey) GROUP BY 1""",
)
def normalize_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cam_id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return C.normalize_points(d, "x", "y", by=("cam_id",)).groupBy("cam_id").agg(F.count("*").alias("n"), tidy(F.sum(F.abs("n_x")), 3).alias("sum_x"), tidy(F.avg(F.sqrt(F.col("n_x") ** 2 + F.col("n_y") ** 2))).alias("mean_distance"))


@register(
    "c9_skew_homogeneous",
    with_(POINTS) + "SELECT pt_id, round(-z, 6) + 0.0 AS s01, round(y, 6) + 0.0 AS s02, round(-x, 6) + 0.0 AS s12, round(x, 6) + 0.0 AS back_x, 4 AS size_h FROM points",
)
def skew_homogeneous(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, h = C.skew(F.col("p")), C.homogeneous(F.col("p"))
    return points(spark, sf_dir).select("pt_id", tidy(s[1]).alias("s01"), tidy(s[2]).alias("s02"), tidy(s[5]).alias("s12"), tidy(C.dehomogeneous(h)[0]).alias("back_x"), F.size(h).alias("size_h"))


@register(
    "c12_axis_conventions",
    with_(CAMERAS) + "SELECT img_id, round(r0, 6) + 0.0 AS r00, round(-r4, 6) + 0.0 AS r11, round(-t2, 6) + 0.0 AS t2, round(c0, 6) + 0.0 AS backward_cx, round(r3, 6) + 0.0 AS again_r10, round(t1, 6) + 0.0 AS again_t1 FROM cameras JOIN centers USING (img_id)",
)
def axis_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, t = C.flip_convention(F.col("R"), F.col("t"))
    d = cameras(spark, sf_dir).withColumns({"flip_r": r, "s": t, "m": C.pose_matrix(F.col("R"), F.col("t"))})
    br, bt = C.from_backward_pose(F.col("m"))
    d = d.withColumns({"br": br, "bt": bt})
    r, t = F.col("flip_r"), F.col("s")
    rr, tt = C.flip_convention(r, t)
    return d.select("img_id", tidy(r[0]).alias("r00"), tidy(r[4]).alias("r11"), tidy(t[2]).alias("t2"), tidy(C.center(F.col("br"), F.col("bt"))[0]).alias("backward_cx"), tidy(rr[3]).alias("again_r10"), tidy(tt[1]).alias("again_t1"))


@register(
    "c17_projection_matrix",
    with_(CAMERAS) + "SELECT img_id, round(800 * r0 + 320 * r6, 4) + 0.0 AS p00, round(800 * t0 + 320 * t2, 4) + 0.0 AS p03, round(800 * r4 + 240 * r7, 4) + 0.0 AS p11, round(t2, 4) + 0.0 AS p23, round(320 / tan(radians(30.0 + img_id % 50) / 2), 4) + 0.0 AS fov_fx FROM cameras",
)
def projection_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.projection_matrix(k(), F.col("R"), F.col("t"))
    f = C.intrinsics_from_fov(F.lit(float(WIDTH)), F.lit(float(HEIGHT)), 30.0 + F.col("img_id") % 50)
    return cameras(spark, sf_dir).select("img_id", tidy(p[0], 4).alias("p00"), tidy(p[3], 4).alias("p03"), tidy(p[5], 4).alias("p11"), tidy(p[11], 4).alias("p23"), tidy(f[0], 4).alias("fov_fx"))


DISTORTED = """
flat AS (SELECT *, xc / zc AS xn, yc / zc AS yn, (xc / zc) ** 2 + (yc / zc) ** 2 AS r2 FROM seen WHERE zc > 0),
lens AS (SELECT cam_id, 800 * (xn * (1 + r2 * (0.1 + r2 * -0.05)) + 0.002 * xn * yn + 0.0005 * (r2 + 2 * xn * xn)) + 320 AS pu, 800 * (yn * (1 + r2 * (0.1 + r2 * -0.05)) + 0.001 * (r2 + 2 * yn * yn) + 0.001 * xn * yn) + 240 AS pv, zc FROM flat)"""


@register(
    "c22_project_distorted",
    with_(CAMERAS, POINTS, OBSERVATIONS, SEEN, DISTORTED) + "SELECT cam_id, count(*)::BIGINT AS n, round(avg(pu), 3) + 0.0 AS mean_u, round(avg(pv), 3) + 0.0 AS mean_v FROM lens GROUP BY cam_id",
)
def project_distorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = seen(spark, sf_dir).withColumn("q", C.world_to_camera(F.col("p"), F.col("R"), F.col("t"))).where(F.col("q")[2] > 0)
    u, v = C.project(F.col("q"), k(), vec(0.1, -0.05, 0.001, 0.0005, 0))
    return d.groupBy("cam_id").agg(F.count("*").alias("n"), tidy(F.avg(u), 3).alias("mean_u"), tidy(F.avg(v), 3).alias("mean_v"))


@register(
    "c23_undistort_round_trip",
    "SELECT l_suppkey AS cam_id, count(*)::BIGINT AS n, round(avg((l_quantity * 12.8 - 320) / 800), 4) + 0.0 AS x, round(avg((l_discount * 4800 - 240) / 800), 4) + 0.0 AS y, 2.0::DOUBLE AS far FROM lineitem GROUP BY 1",
)
def undistort_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = vec(0.1, -0.05, 0.001, 0.0005, 0)
    x, y = (F.col("u") - CX) / FOCAL, (F.col("v") - CY) / FOCAL
    dx, dy = C.distort(x, y, lens)
    d = observations(spark, sf_dir).withColumns({"x": x, "y": y, "du": dx * FOCAL + CX, "dv": dy * FOCAL + CY})
    q = C.ray_point(F.col("du"), F.col("dv"), F.lit(2.0), k(), lens)
    d = d.withColumn("q", q)
    z = F.col("q")[2]
    return d.groupBy("cam_id").agg(F.count("*").alias("n"), tidy(F.avg(F.col("q")[0] / z), 4).alias("x"), tidy(F.avg(F.col("q")[1] / z), 4).alias("y"), tidy(F.max(norm(F.col("q"))), 4).alias("far"))


@register(
    "c24_points_in_frustum",
    with_(CAMERAS, POINTS, OBSERVATIONS, SEEN) + "SELECT cam_id, count(*) FILTER (zc BETWEEN 0.1 AND 12.5 AND 800 * xc / zc + 320 >= 0 AND 800 * xc / zc + 320 < 640 AND 800 * yc / zc + 240 >= 0 AND 800 * yc / zc + 240 < 480)::BIGINT AS inside, count(*)::BIGINT AS n FROM seen GROUP BY cam_id",
)
def in_frustum(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = seen(spark, sf_dir).withColumn("q", C.world_to_camera(F.col("p"), F.col("R"), F.col("t")))
    return d.groupBy("cam_id").agg(F.count_if(C.in_frustum(F.col("q"), k(), F.lit(WIDTH), F.lit(HEIGHT), 0.1, 12.5)).alias("inside"), F.count("*").alias("n"))


@register(
    "c30_interpolate_poses",
    with_(CAMERAS)
    + """SELECT a.img_id, round((a.t0 + b.t0) / 2, 6) + 0.0 AS t0, round((a.t1 + b.t1) / 2, 6) + 0.0 AS t1, round(degrees(acos(greatest(-1.0, least(1.0, (a.r0 * b.r0 + a.r1 * b.r1 + a.r2 * b.r2 + a.r3 * b.r3 + a.r4 * b.r4 + a.r5 * b.r5 + a.r6 * b.r6 + a.r7 * b.r7 + a.r8 * b.r8 - 1) / 2)))) / 2, 3) + 0.0 AS half
FROM cameras a JOIN cameras b ON b.img_id = a.img_id + 1""",
)
def interpolate_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = cameras(spark, sf_dir)
    b = a.select((F.col("img_id") - 1).alias("img_id"), F.col("R").alias("R2"), F.col("t").alias("t2"))
    d = a.join(b, "img_id").withColumn("qa", C.quaternion(F.col("R"))).withColumn("qb", C.quaternion(F.col("R2")))
    d = d.withColumn("q", C.slerp(F.col("qa"), F.col("qb"), F.lit(0.5)))
    d = d.withColumn("m", C.quaternion_matrix(F.col("q")))
    first, second = C.rotation_angle(F.col("R"), F.col("m")), C.rotation_angle(F.col("m"), F.col("R2"))
    return d.select("img_id", *(tidy((F.col("t")[i] + F.col("t2")[i]) / 2).alias(f"t{i}") for i in range(2)), tidy(F.when(F.abs(first - second) < 1e-3, first), 3).alias("half"))


@register("c31_axis_angle", with_(CAMERAS) + "SELECT img_id, round(acos(greatest(-1.0, least(1.0, (r0 + r4 + r8 - 1) / 2))), 5) + 0.0 AS angle, round(r2, 5) + 0.0 AS r2, round(r3, 5) + 0.0 AS r3, round(r7, 5) + 0.0 AS r7 FROM cameras")
def axis_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cameras(spark, sf_dir).withColumn("w", C.matrix_axis_angle(F.col("R")))
    d = d.withColumn("back", C.axis_angle_matrix(F.col("w")))
    return d.select("img_id", tidy(norm(F.col("w")), 5).alias("angle"), *(tidy(F.col("back")[i], 5).alias(f"r{i}") for i in (2, 3, 7)))


@register(
    "c35_backproject_pixels",
    with_(CAMERAS, OBSERVATIONS)
    + """, q AS (SELECT cam_id, (u - 320) / 800 * (2 + pt_id % 5) AS x, (v - 240) / 800 * (2 + pt_id % 5) AS y, (2 + pt_id % 5)::DOUBLE AS z FROM obs)
SELECT cam_id, round(avg(r0 * (x - t0) + r3 * (y - t1) + r6 * (z - t2)), 5) + 0.0 AS wx, round(avg(r2 * (x - t0) + r5 * (y - t1) + r8 * (z - t2)), 5) + 0.0 AS wz FROM q JOIN cameras ON cam_id = img_id GROUP BY cam_id""",
)
def backproject_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = observations(spark, sf_dir).join(cameras(spark, sf_dir), F.col("cam_id") == F.col("img_id"))
    w = C.backproject(F.col("u"), F.col("v"), (2 + F.col("pt_id") % 5).cast("double"), k(), F.col("R"), F.col("t"))
    return d.withColumn("w", w).groupBy("cam_id").agg(tidy(F.avg(F.col("w")[0]), 5).alias("wx"), tidy(F.avg(F.col("w")[2]), 5).alias("wz"))


@register(
    "c36_plane_homography",
    with_(CAMERAS) + """, h AS (SELECT img_id, r0 AS a, r1 AS b, r2 - t0 / 5 AS c, r3 AS d, r4 AS e, r5 - t1 / 5 AS f, r6 AS g, r7 AS h, r8 - t2 / 5 AS i FROM cameras)
SELECT img_id, round((800 * a + 320 * g) / 800, 5) + 0.0 AS h00, round(g / 800, 7) + 0.0 AS h20, round((800 * e + 240 * h) / 800, 5) + 0.0 AS h11, round((800 * d + 240 * g) / 800, 5) + 0.0 AS h10, round(800 * c + 320 * i - (800 * a + 320 * g) * 0.4 - (800 * b + 320 * h) * 0.3, 3) + 0.0 AS h02, round(i - g * 0.4 - h * 0.3, 5) + 0.0 AS h22 FROM h""",
)
def homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = C.plane_homography(k(), k(), F.col("R"), F.col("t"), vec(0, 0, 1), F.lit(5.0))
    return cameras(spark, sf_dir).select("img_id", tidy(h[0], 5).alias("h00"), tidy(h[6], 7).alias("h20"), tidy(h[4], 5).alias("h11"), tidy(h[3], 5).alias("h10"), tidy(h[2], 3).alias("h02"), tidy(h[8], 5).alias("h22"))


@register(
    "g24_pose_difference",
    with_(CAMERAS)
    + """SELECT a.img_id, round(degrees(acos(greatest(-1.0, least(1.0, (a.r0 * b.r0 + a.r1 * b.r1 + a.r2 * b.r2 + a.r3 * b.r3 + a.r4 * b.r4 + a.r5 * b.r5 + a.r6 * b.r6 + a.r7 * b.r7 + a.r8 * b.r8 - 1) / 2)))), 4) + 0.0 AS degrees,
  round(sqrt((x.c0 - y.c0) ** 2 + (x.c1 - y.c1) ** 2 + (x.c2 - y.c2) ** 2), 5) + 0.0 AS baseline
FROM cameras a JOIN cameras b ON b.img_id = a.img_id + 1 JOIN centers x ON x.img_id = a.img_id JOIN centers y ON y.img_id = b.img_id""",
)
def pose_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = cameras(spark, sf_dir).withColumn("c", C.center(F.col("R"), F.col("t")))
    b = a.select((F.col("img_id") - 1).alias("img_id"), F.col("R").alias("R2"), F.col("c").alias("c2"))
    apart = F.sqrt(sum(((F.col("c")[i] - F.col("c2")[i]) ** 2 for i in (1, 2)), (F.col("c")[0] - F.col("c2")[0]) ** 2))
    return a.join(b, "img_id").select("img_id", tidy(C.rotation_angle(F.col("R"), F.col("R2")), 4).alias("degrees"), tidy(apart, 5).alias("baseline"))
