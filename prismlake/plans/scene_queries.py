"""Queries of scenes: pose graphs, rays of images, camera paths, bounds, residuals and frustums."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linear import tidy, vec
from ..operators import cameras as C
from ..operators import clouds as P
from ..operators import paths as W
from ..operators import rendering as N
from ..operators import scenes as S
from ..session import table
from .camera_queries import k, seen
from .fixtures import CAMERAS, OBSERVATIONS, POINTS, SEEN, cameras, parts_cloud, with_
from .pose_queries import EDGES, edges
from .registry import register


def parts_of(c: str, names: str, digits: int = 6) -> list:
    """Columns of a vector's parts."""
    return [tidy(F.col(c)[i], digits).alias(n) for i, n in enumerate(names.split())]


@register("c15_scene_scale", with_(CAMERAS) + "SELECT round(avg(sqrt((a.c0 - b.c0) ** 2 + (a.c1 - b.c1) ** 2 + (a.c2 - b.c2) ** 2)), 5) + 0.0 AS scale FROM centers a JOIN centers b ON a.img_id < b.img_id")
def scene_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scene_scale(cameras(spark, sf_dir)).select(tidy(F.col("scale"), 5).alias("scale"))


@register(
    "c28_decompose_projection",
    with_(CAMERAS) + "SELECT img_id, (800.0 + img_id % 7)::DOUBLE AS fx, (320.0 + img_id % 3)::DOUBLE AS cx, 240.0::DOUBLE AS cy, round(r2, 6) + 0.0 AS r2, round(r3, 6) + 0.0 AS r3, round(r7, 6) + 0.0 AS r7, round(t0, 6) + 0.0 AS t0, round(t1, 6) + 0.0 AS t1, round(t2, 6) + 0.0 AS t2 FROM cameras",
)
def decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vec(800.0 + F.col("img_id") % 7, 0, 320.0 + F.col("img_id") % 3, 0, 790, 240, 0, 0, 1)
    # the scale of a projection matrix says nothing, nor does its sign
    p = cameras(spark, sf_dir).withColumn("k", own).withColumn("P0", C.projection_matrix(F.col("k"), F.col("R"), F.col("t"))).select("img_id", F.transform("P0", lambda x: x * F.when(F.col("img_id") % 2 == 0, 3.0).otherwise(-3.0)).alias("P"))
    d = S.decompose_projection(p)
    return d.select("img_id", tidy(F.col("K")[0]).alias("fx"), tidy(F.col("K")[2]).alias("cx"), tidy(F.col("K")[5]).alias("cy"), *(tidy(F.col("R")[i]).alias(f"r{i}") for i in (2, 3, 7)), *parts_of("t", "t0 t1 t2"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("img_id"))


@register("g14_has_node", "SELECT p_partkey AS img_id, p_partkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) AS present FROM part")
def has_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.has_node(asked(spark, sf_dir), cameras(spark, sf_dir).where("img_id % 3 = 0"))


@register("g15_get_pose", with_(CAMERAS) + "SELECT p_partkey AS img_id, round(r5, 6) + 0.0 AS r5, round(t1, 6) + 0.0 AS t1 FROM part LEFT JOIN cameras ON img_id = p_partkey")
def get_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.get_poses(asked(spark, sf_dir), cameras(spark, sf_dir)).select("img_id", tidy(F.col("R")[5]).alias("r5"), tidy(F.col("t")[1]).alias("t1"))


@register("g16_update_pose", with_(CAMERAS) + "SELECT img_id, round(CASE WHEN img_id % 4 = 0 THEN r4 ELSE r0 END, 6) + 0.0 AS r0, round(CASE WHEN img_id % 4 = 0 THEN img_id % 5 + 0.5 ELSE t0 END, 6) + 0.0 AS t0 FROM cameras")
def update_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cameras(spark, sf_dir)
    fresh = c.where("img_id % 4 = 0").select("img_id", vec(*(F.col("R")[(i + 4) % 9] for i in range(9))).alias("R"), vec(F.col("img_id") % 5 + 0.5, 0, 0).alias("t"))
    absent = fresh.withColumn("img_id", F.col("img_id") + 1_000_000_000)
    return S.update_poses(c, fresh.unionByName(absent)).select("img_id", tidy(F.col("R")[0]).alias("r0"), tidy(F.col("t")[0]).alias("t0"))


@register(
    "g17_next_image",
    with_(EDGES)
    + """, bi AS (SELECT src AS img_id, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges)
SELECT img_id, count(*)::BIGINT AS links FROM bi WHERE img_id % 3 <> 0 AND other % 3 = 0 GROUP BY 1 ORDER BY links DESC, img_id LIMIT 1""",
)
def next_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    registered = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("img_id"))
    return S.best_next(edges(spark, sf_dir), registered)


@register("g18_trajectory", with_(CAMERAS) + "SELECT img_id, round(c0, 6) + 0.0 AS x, round(c1, 6) + 0.0 AS y, round(c2, 6) + 0.0 AS z FROM centers")
def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trajectory(cameras(spark, sf_dir)).select("img_id", *parts_of("c", "x y z"))


@register("g19_baselines", with_(CAMERAS) + "SELECT a.img_id AS i, a.img_id * 3 AS j, round(coalesce(sqrt((a.c0 - b.c0) ** 2 + (a.c1 - b.c1) ** 2 + (a.c2 - b.c2) ** 2), 0.0), 6) + 0.0 AS baseline FROM centers a LEFT JOIN centers b ON b.img_id = a.img_id * 3")
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cameras(spark, sf_dir)
    return S.baselines(c.select(F.col("img_id").alias("i"), (F.col("img_id") * 3).alias("j")), c).select("i", "j", tidy(F.col("baseline")).alias("baseline"))


@register("g20_graph_json", with_(CAMERAS) + "SELECT img_id, round(r3, 6) + 0.0 AS r3, round(r8, 6) + 0.0 AS r8, round(t1, 6) + 0.0 AS t1 FROM cameras")
def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst"), F.lit(1).alias("weight"))
    return S.from_json(S.to_json(cameras(spark, sf_dir), edges)).select("img_id", tidy(F.col("R")[3]).alias("r3"), tidy(F.col("R")[8]).alias("r8"), tidy(F.col("t")[1]).alias("t1"))


@register("g20_graph_edges_json", with_(EDGES) + "SELECT src, dst, weight FROM edges")
def graph_edges_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.edges_from_json(S.to_json(cameras(spark, sf_dir), edges(spark, sf_dir)))


RAYS = """
grid AS (SELECT img_id, r, c, r0, r1, r2, r3, r4, r5, r6, r7, r8, (c - 2.5) / 50 AS a, (r - 1.5) / 40 AS b FROM cameras, range(0, 4) x(r), range(0, 6) y(c)),
world AS (SELECT img_id, r, c, r0 * a + r3 * b + r6 AS dx, r1 * a + r4 * b + r7 AS dy, r2 * a + r5 * b + r8 AS dz FROM grid),
rays AS (SELECT img_id, r::INT AS row, c::INT AS col, round(c0, 6) + 0.0 AS ox, round(dx / (sqrt(dx * dx + dy * dy + dz * dz) + 1e-8), 6) + 0.0 AS dx, round(dy / (sqrt(dx * dx + dy * dy + dz * dz) + 1e-8), 6) + 0.0 AS dy, round(dz / (sqrt(dx * dx + dy * dy + dz * dz) + 1e-8), 6) + 0.0 AS dz FROM world JOIN centers USING (img_id))"""


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.image_rays(cameras(spark, sf_dir), 6, 4, 50.0, 2.5, 1.5, focal_y=40.0)
    return d.select("img_id", "row", "col", tidy(F.col("origin")[0]).alias("ox"), *parts_of("direction", "dx dy dz"))


@register("r2_image_rays", with_(CAMERAS, RAYS) + "SELECT * FROM rays")
def image_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rays(spark, sf_dir)


@register("r3_rays_of_even_images", with_(CAMERAS, RAYS) + "SELECT * FROM rays WHERE img_id % 2 = 0")
def some_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rays(spark, sf_dir).where("img_id % 2 = 0")


NORMAL = """
mid AS (SELECT avg(c0) AS m0, avg(c1) AS m1, avg(c2) AS m2 FROM centers),
far AS (SELECT quantile_cont(sqrt((c0 - m0) ** 2 + (c1 - m1) ** 2 + (c2 - m2) ** 2), 0.9) AS s FROM centers, mid)"""


@register("r5_normalized_poses", with_(CAMERAS, NORMAL) + "SELECT img_id, round((c0 - m0) / s, 6) + 0.0 AS x, round((c1 - m1) / s, 6) + 0.0 AS y, round((c2 - m2) / s, 6) + 0.0 AS z, round(s, 6) AS scale FROM centers, mid, far")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.normalized(cameras(spark, sf_dir)).select("img_id", *parts_of("c", "x y z"), tidy(F.col("scale")).alias("scale"))


@register("r6_denormalized_poses", with_(CAMERAS) + "SELECT img_id, round(c0, 6) + 0.0 AS x, round(c1, 6) + 0.0 AS y, round(c2, 6) + 0.0 AS z FROM centers")
def denormalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.denormalized(S.normalized(cameras(spark, sf_dir))).select("img_id", *parts_of("c", "x y z"))


@register("r7_near_far", with_(CAMERAS, POINTS, OBSERVATIONS, SEEN) + "SELECT round(greatest(0.01, quantile_cont(zc, 0.001)), 5) AS near, round(quantile_cont(zc, 0.999), 5) AS far FROM seen WHERE zc > 0")
def near_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = seen(spark, sf_dir).select(C.world_to_camera(F.col("p"), F.col("R"), F.col("t"))[2].alias("z"))
    return S.near_far(z).select(tidy(F.col("near"), 5).alias("near"), tidy(F.col("far"), 5).alias("far"))


@register(
    "r7_spacing_near_far",
    with_(CAMERAS, NORMAL) + "SELECT round(greatest(0.01, 0.1 * min(d)), 6) AS near, round(5 * max(d), 6) AS far FROM (SELECT sqrt((c0 - m0) ** 2 + (c1 - m1) ** 2 + (c2 - m2) ** 2) AS d FROM centers, mid)",
)
def spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spacing_near_far(cameras(spark, sf_dir)).select(tidy(F.col("near")).alias("near"), tidy(F.col("far")).alias("far"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, n: a frame for each supplier."""
    s = table(spark, sf_dir, "supplier")
    return s.crossJoin(F.broadcast(s.agg(F.count("*").alias("n")))).select(F.col("s_suppkey").alias("i"), "n")


FRAMES = """
frames AS (SELECT s_suppkey AS i, n, 2 * pi() * s_suppkey / n AS th FROM supplier, (SELECT count(*) AS n FROM supplier))"""
LOOK = """
unit AS (SELECT i, px, py, pz, -px / (sqrt(px * px + py * py + pz * pz) + 1e-8) AS fx, -py / (sqrt(px * px + py * py + pz * pz) + 1e-8) AS fy, -pz / (sqrt(px * px + py * py + pz * pz) + 1e-8) AS fz FROM pos),
side AS (SELECT *, {side} FROM unit),
rights AS (SELECT i, px, py, pz, fx, fy, fz, sx / (sqrt(sx * sx + sy * sy + sz * sz) + 1e-8) AS rx, sy / (sqrt(sx * sx + sy * sy + sz * sz) + 1e-8) AS ry, sz / (sqrt(sx * sx + sy * sy + sz * sz) + 1e-8) AS rz FROM side),
ups AS (SELECT *, ry * fz - rz * fy AS ux, rz * fx - rx * fz AS uy, rx * fy - ry * fx AS uz FROM rights)
SELECT i, round(rx, 6) + 0.0 AS rx, round({s} * uy, 6) + 0.0 AS uy, round({z} * fz, 6) + 0.0 AS bz, round(px, 6) + 0.0 AS px, round(py, 6) + 0.0 AS py, round(pz, 6) + 0.0 AS pz FROM ups"""
UP_Y, UP_Z = "-fz AS sx, 0.0 AS sy, fx AS sz", "fy AS sx, -fx AS sy, 0.0 AS sz"


def path_columns(d: DataFrame) -> DataFrame:
    m = F.col("c2w")
    return d.select("i", *(tidy(m[at]).alias(n) for n, at in (("rx", 0), ("uy", 5), ("bz", 10), ("px", 3), ("py", 7), ("pz", 11))))


@register("r9_orbit_path", with_(FRAMES, "pos AS (SELECT i, 4 * cos(th) AS px, 0.5::DOUBLE AS py, 4 * sin(th) AS pz FROM frames)", LOOK.format(side=UP_Y, s="1", z="-1")).rstrip())
def orbit_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return path_columns(W.orbit(f, 2 * math.pi * F.col("i") / F.col("n"), 4.0, 0.5))


@register("r10_wave_path", with_(FRAMES, "pos AS (SELECT i, 3 * cos(th) AS px, 3 * sin(th) AS py, 0.8 * sin(2 * th) AS pz FROM frames)", LOOK.format(side=UP_Z, s="1", z="-1")).rstrip())
def wave_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return path_columns(W.wave(f, 2 * math.pi * F.col("i") / F.col("n"), 3.0, 0.8))


@register(
    "r12_camera_levels",
    with_(
        FRAMES,
        """each AS (SELECT i, n // 3 AS e, CASE WHEN i < (n // 3) * 3 THEN i ELSE 0 END AS q FROM frames),
ang AS (SELECT i, 2 * pi() * (q % e) / e AS a, radians(-12.5 + (q // e) * 18.75) AS el FROM each),
pos AS (SELECT i, 3.5 * cos(el) * cos(a) AS px, 3.5 * sin(el) AS py, 3.5 * cos(el) * sin(a) AS pz FROM ang)""",
        LOOK.format(side=UP_Y, s="-1", z="1"),
    ).rstrip(),
)
def camera_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_columns(W.levels(frames(spark, sf_dir), F.col("i"), F.col("n"), 3.5, 25.0, 3))


@register("r8_spiral_path", None)
def spiral_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    poses = cameras(spark, sf_dir).select("img_id", C.pose_matrix(F.col("R"), F.col("t")).alias("c2w"))
    return path_columns(W.spiral(frames(spark, sf_dir), F.col("i") / F.col("n"), poses))


BOX = """
box AS (SELECT p_partkey, (p_size - 25) / 25.0::DOUBLE AS x, (p_partkey % 31 - 15) / 15.0::DOUBLE AS y, (p_partkey % 17 - 8) / 8.0::DOUBLE AS z FROM part),
nrm AS (SELECT p_partkey, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN sign(x) ELSE 0 END AS nx, CASE WHEN NOT (abs(x) >= abs(y) AND abs(x) >= abs(z)) AND abs(y) >= abs(z) THEN sign(y) ELSE 0 END AS ny,
  CASE WHEN NOT (abs(x) >= abs(y) AND abs(x) >= abs(z)) AND NOT abs(y) >= abs(z) THEN sign(z) ELSE 0 END AS nz FROM box)"""


@register("r15_box_normal", with_(BOX) + "SELECT p_partkey, nx::INT AS nx, ny::INT AS ny, nz::INT AS nz FROM nrm")
def box_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box(spark, sf_dir).select("p_partkey", *(F.col("n")[i].cast("int").alias(f"n{a}") for i, a in enumerate("xyz")))


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", vec((F.col("p_size") - 25) / 25.0, (F.col("p_partkey") % 31 - 15) / 15.0, (F.col("p_partkey") % 17 - 8) / 8.0).alias("q"))
    return p.withColumn("n", S.box_normal(F.col("q")))


@register("r16_shade", with_(BOX) + "SELECT p_partkey, floor(least(255.0, 200 * (0.25 + 0.75 * greatest(0.0, (0.5 * nx + ny + 0.7 * nz) / sqrt(0.25 + 1 + 0.49)))))::INT AS blue FROM nrm")
def shaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = math.sqrt(0.25 + 1 + 0.49)
    return box(spark, sf_dir).select("p_partkey", F.floor(F.least(F.lit(255.0), 200 * N.shade(F.col("n"), vec(0.5 / d, 1 / d, 0.7 / d)))).cast("int").alias("blue"))


@register(
    "b2_residuals",
    with_(CAMERAS, POINTS, OBSERVATIONS, SEEN)
    + """, res AS (SELECT cam_id, CASE WHEN zc > 1e-8 THEN 800 * xc / zc + 320 - u ELSE 0 END AS du, CASE WHEN zc > 1e-8 THEN 800 * yc / zc + 240 - v ELSE 0 END AS dv FROM seen)
SELECT cam_id, cam_id = 1 AS fixed, count(*)::BIGINT AS n, round(avg(du), 3) + 0.0 AS du, round(avg(dv), 3) + 0.0 AS dv, round(avg(du * du + dv * dv), 1) + 0.0 AS cost FROM res GROUP BY ALL""",
)
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.residuals(seen(spark, sf_dir), k(), F.col("cam_id") == 1)
    cost = F.avg(F.col("du") ** 2 + F.col("dv") ** 2)
    return d.groupBy("cam_id", "fixed").agg(F.count("*").alias("n"), tidy(F.avg("du"), 3).alias("du"), tidy(F.avg("dv"), 3).alias("dv"), tidy(cost, 1).alias("cost"))


@register(
    "i13_frustum_segments",
    with_(CAMERAS)
    + """, corner(k, x, y, z) AS (VALUES (0, 0.0, 0.0, 0.0), (1, -0.12, -0.09, 0.3), (2, 0.12, -0.09, 0.3), (3, 0.12, 0.09, 0.3), (4, -0.12, 0.09, 0.3)),
edge(e, a, b) AS (VALUES (0, 0, 1), (1, 0, 2), (2, 0, 3), (3, 0, 4), (4, 1, 2), (5, 2, 3), (6, 3, 4), (7, 4, 1)),
w AS (SELECT img_id, k, c0 + r0 * x + r3 * y + r6 * z AS wx, c2 + r2 * x + r5 * y + r8 * z AS wz FROM cameras JOIN centers USING (img_id), corner)
SELECT p.img_id, e::INT AS edge, round(p.wx, 5) + 0.0 AS ax, round(p.wz, 5) + 0.0 AS az, round(q.wx, 5) + 0.0 AS bx, round(q.wz, 5) + 0.0 AS bz FROM edge JOIN w p ON p.k = a JOIN w q ON q.k = b AND q.img_id = p.img_id""",
)
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.frustum_segments(cameras(spark, sf_dir), 640, 480, 800.0)
    return d.select("img_id", "edge", tidy(F.col("a")[0], 5).alias("ax"), tidy(F.col("a")[2], 5).alias("az"), tidy(F.col("b")[0], 5).alias("bx"), tidy(F.col("b")[2], 5).alias("bz"))


@register(
    "v6_smoothed_curve",
    """WITH o AS (SELECT event_type, event_id, value, row_number() OVER w AS at, sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
l AS (SELECT *, least(500, n // 10) AS w FROM o WHERE n > 100)
SELECT l.event_type, l.event_id, round((l.s - coalesce(p.s, 0)) / l.w + 1e-7, 4) + 0.0 AS smooth FROM l LEFT JOIN l p ON p.event_type = l.event_type AND p.at = l.at - l.w WHERE l.at >= l.w""",
)
def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.training_curve(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value").select("event_type", "event_id", tidy(F.col("smooth") + 1e-7, 4).alias("smooth"))


@register("h1_normals", None)
def normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts_cloud(spark, sf_dir)
    return S.normals(p, P.neighbours(p, 20)).select("pt_id", *parts_of("n", "nx ny nz"))
