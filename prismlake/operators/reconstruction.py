"""Incremental reconstruction: tracks of matched features, a first pair, and a loop that registers images.

Tracks are the components of the graph of matched features. What the loop carries is the table of
cameras; points follow from it by linear triangulation of all views of a track. Each round registers the
images of each model that see most points, all at once where several see nearly as many, and every few rounds cameras
and points are adjusted together. Where no image sees enough points, since images share few with each other, those that
have relative poses to two registered ones are laid by these. The driver holds what has the size of the cameras.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, materialize
from .bundle import LISTS, MOST_CAMERAS, bundle_adjust, crossed, turned
from .cameras import intrinsics
from .components import components
from .poses import reprojection_errors
from .resection import Camera, poses_from_points
from .two_view import _seed, decompose, essential, fundamental, reprojection, triangulated

#: Observations to a part, on average, whose points are located together.
PART = 50_000
#: Pixels and degrees that a point's views must keep, images' points and inliers at least, rounds between adjustments.
PIXELS, DEGREES, LEAST, INLIERS, INTERVAL = 4.0, 2.0, 30, 6, 3
#: Cameras, as a multiple of those that the last adjustment had, at which the next one is due: adjustments stay few however many images there are.
GROWN = 1.2
#: Share of the error that a step must take away, to be followed by another, before the last adjustment.
ROUGHLY = 0.1
#: Matches to a part, on average, whose pairs get their poses.
MATCHES = 20_000
#: Matches that a pair keeps, at least, if its relative pose lays images (any eight fit one), and degrees within which poses agree.
TRUSTED, AGREE = 9, 1.0
#: Images that see at least this share of the points that the best one sees are registered with it.
NEARLY = 0.7


def tracks(matches: DataFrame, features: DataFrame) -> DataFrame:
    """track, img_id, feat_id, u, v: features (img_id, feat_id, u, v) that matches (img_a, feat_a, img_b, feat_b) join.

    Image ids lie below 2**31 and feature ids below 2**32. Tracks with two features of one image say nothing certain, and are left out.
    """
    node = lambda img, feat: F.shiftleft(F.col(img).cast("long"), 32) + F.col(feat)
    found = components(matches.select(node("img_a", "feat_a").alias("a"), node("img_b", "feat_b").alias("b")))
    rows = features.select(F.col("img_id").cast("long").alias("img_id"), F.col("feat_id").cast("long").alias("feat_id"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"), node("img_id", "feat_id").alias("node"))
    rows = rows.join(found, "node").select(F.col("component").alias("track"), "img_id", "feat_id", "u", "v")
    twice = rows.groupBy("track", "img_id").count().where("count > 1").select("track").distinct()
    return rows.join(twice, "track", "left_anti")


def polished(r: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A relative pose with the least squared distances of rays (n x 3, z = 1) from their epipolar lines, by steps that never raise them."""

    def state(r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        turned_a, e = a @ r.T, crossed(t[None])[0] @ r
        to, back = a @ e.T, b @ e
        size = np.sqrt(np.maximum((to[:, :2] ** 2).sum(axis=1) + (back[:, :2] ** 2).sum(axis=1), 1e-24))
        return turned_a, size, (b * to).sum(axis=1) / size

    turned_a, size, away = state(r, t)
    for _ in range(5):
        u = np.linalg.svd(t[None])[2][1:]  # the ways in which t can turn
        j = np.column_stack([np.cross(turned_a, np.cross(b, t)), np.cross(turned_a, b) @ u.T]) / size[:, None]
        step = np.linalg.lstsq(j, -away, rcond=None)[0]
        r2, t2 = turned(step[None, :3])[0] @ r, t + step[3:] @ u
        t2 = t2 / np.linalg.norm(t2)
        turned_2, size_2, away_2 = state(r2, t2)
        if not (away_2**2).sum() < (away**2).sum():
            break
        r, t, turned_a, size, away = r2, t2, turned_2, size_2, away_2
    return r, t


def first_pairs(matches: DataFrame, k: Camera, threshold: float = 1.0) -> DataFrame:
    """img_a, img_b, score, R, t of pairs of images (img_a, img_b, u1, v1, u2, v2): the matches whose points a first pair would keep, and the second pose."""
    km = np.array([[k[0], 0, k[2]], [0, k[1], k[3]], [0, 0, 1.0]])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, b = (int(x.as_py()) for x in key)
        x = np.column_stack([np.array(table.column(c), float) for c in ("u1", "v1", "u2", "v2")])
        x = x[np.lexsort(x.T[::-1])]
        x1, x2, r, t, score = x[:, :2], x[:, 2:], None, None, 0
        f, inside = fundamental(x1, x2, threshold, _seed((a, b)))
        if f is not None:
            r, t, _ = decompose(essential(f, km), km, x1[inside], x2[inside])
            r, t = polished(r, t, *(np.column_stack([x[inside], np.ones(inside.sum())]) @ np.linalg.inv(km).T for x in (x1, x2)))
            p = triangulated(km @ np.eye(3, 4), km @ np.column_stack([r, t]), x1[inside], x2[inside])
            near = (reprojection(km, np.eye(3), np.zeros(3), p, x1[inside]) < PIXELS) & (reprojection(km, r, t, p, x2[inside]) < PIXELS)
            away = p + r.T @ t
            angle = np.degrees(np.arccos(np.clip((p * away).sum(axis=1) / np.maximum(np.linalg.norm(p, axis=1) * np.linalg.norm(away, axis=1), 1e-12), -1, 1)))
            score = int((near & (p[:, 2] > 0) & ((p @ r.T + t)[:, 2] > 0) & (angle >= DEGREES)).sum())
            r, t = r.ravel().tolist(), t.tolist()
        return pa.table({"img_a": pa.array([a], pa.int64()), "img_b": pa.array([b], pa.int64()), "score": pa.array([score], pa.int64()), "R": pa.array([r], LISTS), "t": pa.array([t], LISTS)})

    return matches.select("img_a", "img_b", "u1", "v1", "u2", "v2").groupBy("img_a", "img_b").applyInArrow(run, "img_a long, img_b long, score long, R array<double>, t array<double>")


def laid(pairs: list[tuple], cameras: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Poses of images that relative poses to two cameras or more tell, one after the other; pairs: (img_a, img_b, R, t) with t of any length.

    The two or more must agree on the image's turn, and its centre lies where the ways from theirs meet, ahead on all of them.
    """
    ways, known, new = defaultdict(list), dict(cameras), {}
    for a, b, r, t in pairs:
        ways[b].append((a, r, t))
        ways[a].append((b, r.T, -r.T @ t))
    queue = deque(i for i in sorted(ways) if i not in known)
    least, agree = 1 - np.cos(np.radians(DEGREES)), np.cos(np.radians(AGREE))
    while queue:
        i = queue.popleft()
        own = [(known[a], r, t) for a, r, t in ways[i] if a in known]
        if i in known or len(own) < 2:
            continue
        turns = np.stack([r @ c[0] for c, r, _ in own])
        alike = (np.einsum("aij,bij->ab", turns, turns) - 1) / 2 >= agree
        some = alike[alike.sum(axis=1).argmax()]
        if some.sum() < 2:
            continue
        u, _, vt = np.linalg.svd(turns[some].sum(axis=0))
        turn = u @ vt
        way = -np.stack([t for _, _, t in own])[some] @ turn
        way /= np.linalg.norm(way, axis=1, keepdims=True)
        start = np.stack([-c[0].T @ c[1] for c, _, _ in own])[some]
        across = np.eye(3) - way[:, :, None] * way[:, None, :]
        total = across.sum(axis=0)
        if np.linalg.eigvalsh(total)[0] < least:  # from all in one line
            continue
        center = np.linalg.solve(total, np.einsum("nij,nj->i", across, start))
        gone = center - start
        if ((gone * way).sum(axis=1) < agree * np.linalg.norm(gone, axis=1)).any():
            continue
        known[i] = new[i] = turn, -turn @ center
        queue.extend(a for a, _, _ in ways[i] if a not in known)
    return new


def _located(k: Camera):
    """Of whole tracks (track, u, v, R, t): the points that all views agree on within the bounds."""
    km = np.array([[k[0], 0, k[2]], [0, k[1], k[3]], [0, 0, 1.0]])

    def fit(track: np.ndarray, p34: np.ndarray, uv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tracks, and their points by the least eigenvector of the sums over their views."""
        first = np.flatnonzero(np.concatenate([[True], track[1:] != track[:-1]]))
        rows = uv[:, :, None] * p34[:, 2:3, :] - p34[:, :2, :]
        m = np.add.reduceat(np.einsum("nij,nik->njk", rows, rows), first, axis=0)
        x = np.linalg.eigh(m)[1][:, :, 0]
        w = np.where(np.abs(x[:, 3]) < 1e-12, 1e-12, x[:, 3])
        return first, x[:, :3] / w[:, None]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("track", "ascending"), ("img_id", "ascending")])
        track = np.array(table.column("track"), np.int64)
        uv = np.column_stack([np.array(table.column(c), float) for c in "uv"])
        r, t = (np.array(table.column(c).combine_chunks().flatten(), float).reshape(-1, *shape) for c, shape in (("R", (3, 3)), ("t", (3,))))
        out = []
        for last in (False, True):  # views that disagree go once
            count = np.bincount(np.unique(track, return_inverse=True)[1]) if len(track) else np.zeros(0, int)
            some = np.repeat(count >= 2, count)
            track, uv, r, t = track[some], uv[some], r[some], t[some]
            if not len(track):
                break
            first, p = fit(track, km @ np.concatenate([r, t[:, :, None]], axis=2), uv)
            sizes = np.diff(first, append=len(track))
            own = np.repeat(p, sizes, axis=0)
            q = np.einsum("nij,nj->ni", r, own) + t
            z = np.where(q[:, 2] > 1e-8, q[:, 2], 1.0)
            good = (q[:, 2] > 1e-8) & (np.hypot(k[0] * q[:, 0] / z + k[2] - uv[:, 0], k[1] * q[:, 1] / z + k[3] - uv[:, 1]) < PIXELS)
            if last or good.all():
                ray = np.einsum("nji,nj->ni", r, q)  # from the camera's centre to the point
                ray /= np.maximum(np.linalg.norm(ray, axis=1, keepdims=True), 1e-12)
                cosine = np.clip((ray * np.repeat(ray[first], sizes, axis=0)).sum(axis=1), -1, 1)
                keep = np.logical_and.reduceat(good, first) & (np.degrees(np.arccos(np.minimum.reduceat(cosine, first))) >= DEGREES)
                out = [(track[first][keep], p[keep], sizes[keep])]
                break
            track, uv, r, t = track[good], uv[good], r[good], t[good]
        ids, p, n = out[0] if out else (np.empty(0, np.int64), np.empty((0, 3)), np.empty(0, np.int64))
        return pa.table({"pt_id": pa.array(ids, pa.int64()), "p": pa.array(p.tolist(), LISTS), "views": pa.array(n.astype(np.int64))})

    return run


@dataclass
class Reconstruction:
    """cameras (img_id, R, t, model), points (pt_id, p) and the observations (img_id, pt_id, u, v) that keep to them.

    Images that no matches join are models of their own, each in its own frame; a model is named by its least image.
    """

    cameras: DataFrame
    points: DataFrame
    observations: DataFrame

    def cloud(self) -> DataFrame:
        """pt_id, x, y, z, views: the images that see the point."""
        views = self.observations.groupBy("pt_id").agg(F.count("*").alias("views"))
        return self.points.join(views, "pt_id").select("pt_id", *(F.col("p")[i].alias(a) for i, a in enumerate("xyz")), "views")


class _Loop:
    def __init__(self, spark: SparkSession, seen: DataFrame, k: Camera, models: dict[int, int]) -> None:
        self.spark, self.k, self.scratch, self.models = spark, k, Scratch(spark), models
        self.seen = self.scratch.table(seen.select("track", "img_id", "u", "v"), "tracks")
        self.parts, self.cams = max(1, -(-self.seen.count() // PART)), {}

    def cameras(self) -> DataFrame:
        if len(self.cams) > MOST_CAMERAS:
            raise ValueError(f"more than {MOST_CAMERAS} cameras")
        ids = sorted(self.cams)
        return self.spark.createDataFrame(pa.table({"img_id": pa.array(ids, pa.int64()), "R": pa.array([self.cams[i][0] for i in ids], LISTS), "t": pa.array([self.cams[i][1] for i in ids], LISTS)}))

    def laid(self, posed: DataFrame) -> dict[int, tuple[list, list]]:
        """Poses of images that relative poses (component, img_a, img_b, R, t) lay, model by model."""

        def run(key: tuple, pairs: pa.Table, cameras: pa.Table) -> pa.Table:
            pose = lambda x: (np.array(x["R"]).reshape(3, 3), np.array(x["t"]))
            pairs = pairs.sort_by([("img_a", "ascending"), ("img_b", "ascending")]).to_pylist()
            new = laid([(x["img_a"], x["img_b"], *pose(x)) for x in pairs], {x["img_id"]: pose(x) for x in cameras.to_pylist()})
            return pa.table({"img_id": pa.array(list(new), pa.int64()), "R": pa.array([r.ravel().tolist() for r, _ in new.values()], LISTS), "t": pa.array([t.tolist() for _, t in new.values()], LISTS)})

        ids = sorted(self.cams)
        models = self.spark.createDataFrame(pa.table({"img_id": pa.array(ids, pa.int64()), "component": pa.array([self.models[i] for i in ids], pa.int64())}))
        known = self.cameras().join(models, "img_id")
        found = posed.groupBy("component").cogroup(known.groupBy("component")).applyInArrow(run, "img_id long, R array<double>, t array<double>")
        return {r.img_id: (list(r.R), list(r.t)) for r in found.collect()}

    def points(self) -> DataFrame:
        """The points of all tracks that two registered images see."""
        rows = self.seen.join(self.cameras(), "img_id").withColumn("part", F.pmod(F.xxhash64("track"), F.lit(self.parts)))
        return self.scratch.table(rows.select("part", "track", "img_id", "u", "v", "R", "t").groupBy("part").applyInArrow(_located(self.k), "pt_id long, p array<double>, views long"), "points")

    def correspondences(self, points: DataFrame) -> DataFrame:
        """Points in images that aren't registered."""
        out = self.seen.join(self.cameras().select("img_id"), "img_id", "left_anti")
        return out.join(points.select(F.col("pt_id").alias("track"), "p"), "track").select("img_id", "p", "u", "v")

    def fitting(self, points: DataFrame) -> DataFrame:
        """The observations within the bound of pixels of registered images."""
        rows = self.seen.join(self.cameras(), "img_id").withColumnRenamed("track", "pt_id").join(points.select("pt_id", "p"), "pt_id")
        fx, fy, cx, cy = map(F.lit, self.k)
        return reprojection_errors(rows, intrinsics(fx, fy, cx, cy)).where(F.col("error") < PIXELS).select("img_id", "pt_id", "u", "v")

    def adjust(self, points: DataFrame, rounds: int, tolerance: float = 1e-6) -> DataFrame:
        held = {self.models[i]: i for i in sorted(self.cams, reverse=True)}  # the least of each model
        done = bundle_adjust(self.cameras(), points, self.fitting(points), self.k, list(held.values()), rounds=rounds, tolerance=tolerance)
        self.cams = {r.img_id: (list(r.R), list(r.t)) for r in done.cameras.collect()}
        return done.points


def reconstruct(features: DataFrame, matches: DataFrame, k: Camera, least: int = LEAST, interval: int = INTERVAL, rounds: int = 30) -> Reconstruction:
    """Cameras, points and observations from features (img_id, feat_id, u, v) and verified matches (img_a, feat_a, img_b, feat_b).

    Of each model the pair with most points that both see well, ahead, and at an angle is first; its first camera is the
    origin and its second one lies at distance 1. Models grow side by side, in the same rounds. Rounds go on while an image that isn't registered sees
    at least `least` points and finds a pose that INLIERS of them keep; one that fails waits until it sees more. Where none does,
    images are laid by relative poses to two registered ones, of pairs that keep TRUSTED matches.
    After interval rounds, once enough cameras have come, and at the end, cameras and points are adjusted. No pair raises an error.
    """
    spark = features.sparkSession
    at = features.select(F.col("img_id").alias("i"), F.col("feat_id").alias("f"), "u", "v")
    pairs = matches.join(at.toDF("img_a", "feat_a", "u1", "v1"), ["img_a", "feat_a"]).join(at.toDF("img_b", "feat_b", "u2", "v2"), ["img_b", "feat_b"])
    joined = materialize(components(matches.select(F.col("img_a").cast("long").alias("a"), F.col("img_b").cast("long").alias("b")).distinct()), "models")
    order = Window.partitionBy("component").orderBy(F.desc("score"), "img_a", "img_b")
    pairs = materialize(pairs.select("img_a", "img_b", "u1", "v1", "u2", "v2"), "pairs")
    pairs = pairs.repartition(max(1, -(-pairs.count() // MATCHES)), "img_a", "img_b")
    good = materialize(first_pairs(pairs, k).where("score > 0").join(joined.withColumnRenamed("node", "img_a"), "img_a"), "posed")
    posed = good.where(F.col("score") >= TRUSTED).select("component", "img_a", "img_b", "R", "t")
    first = good.withColumn("rank", F.row_number().over(order)).where("rank = 1").collect()
    if not first:
        raise ValueError("no two images to begin with")
    models = {r.node: r.component for r in joined.limit(MOST_CAMERAS + 1).collect()}
    if len(models) > MOST_CAMERAS:
        raise ValueError(f"more than {MOST_CAMERAS} cameras")
    loop = _Loop(spark, tracks(matches, features), k, models)
    loop.cams = {r.img_a: (np.eye(3).ravel().tolist(), [0.0] * 3) for r in first} | {r.img_b: (r.R, r.t) for r in first}
    points, failed, done, adjusted = loop.points(), {}, 0, len(loop.cams)
    while True:
        to = loop.scratch.table(loop.correspondences(points), "correspondences")
        counts = {r.img_id: r["count"] for r in to.groupBy("img_id").count().where(F.col("count") >= least).collect()}
        counts = {i: n for i, n in counts.items() if n > failed.get(i, 0)}
        if not counts:
            found = loop.laid(posed)
            if not found:
                break
            loop.cams |= found
            points, done = loop.points(), done + 1
            continue
        best: dict[int, int] = {}
        for i, n in counts.items():
            best[models[i]] = max(n, best.get(models[i], 0))
        chosen = [i for i, n in counts.items() if n >= NEARLY * best[models[i]]]
        asked = spark.createDataFrame(pa.table({"img_id": pa.array(chosen, pa.int64())}))
        poses = poses_from_points(to.join(asked, "img_id", "left_semi"), k, PIXELS).where(F.col("n_inliers") >= INLIERS).collect()
        failed |= {i: counts[i] for i in chosen}
        if not poses:
            continue
        loop.cams |= {r.img_id: (list(r.R), list(r.t)) for r in poses}
        points, done = loop.points(), done + 1
        if done >= interval and len(loop.cams) >= GROWN * adjusted:
            loop.adjust(points, rounds, ROUGHLY)
            done, adjusted = 0, len(loop.cams)
            points = loop.points()
    points = materialize(loop.adjust(points, rounds), "points")
    names = spark.createDataFrame(pa.table({"img_id": pa.array(models, pa.int64()), "model": pa.array(models.values(), pa.int64())}))
    out = Reconstruction(loop.cameras().join(names, "img_id"), points, materialize(loop.fitting(points), "observations"))
    loop.scratch.clear()
    return out
