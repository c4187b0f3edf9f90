"""Fusion of depth maps in a sparse volume of truncated signed distances, and the surfaces that stand in it.

Voxels are rows (ix, iy, iz) whose corner samples lie at their index times the voxel's length. Blocks of
voxels come into being where rays meet surfaces; in each image every voxel of the image's blocks asks the
pixel that it projects to. A task meets its images one by one, each whole (some 100 bytes a pixel), and adds
up their voxels before any is a row. Distances are summed as whole numbers, so that sums have no order and
reruns agree to the bit.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

AXES = ("ix", "iy", "iz")
#: Voxels along a block's side, and parts of the truncated distance and of a colour that are told apart.
SIDE, STEPS = 8, 1 << 20
#: A block's voxels, the first axis fastest.
INSIDE = np.array([[n // SIDE**k % SIDE for k in range(3)] for n in range(SIDE**3)])
#: Blocks that are met at once, and those whose sums a task holds before it passes them on (8 KB each, and as much for each colour).
BLOCKS, HELD = 256, 4096
#: Indices lie below this magnitude: three of them and an edge's direction make one number.
MOST_INDEX = 1 << 19

Optics = tuple[float, float, float]


def integrate(pixels: DataFrame, cameras: DataFrame, optics: Optics, voxel: float = 0.005, trunc: float = 0.04, farthest: float = 5.0, colours: tuple[str, ...] = ()) -> DataFrame:
    """ix, iy, iz, weight, tsdf and mean colours of all voxels that an image sees not more than trunc behind its surface.

    pixels: img_id, whole u and v, depth d, and colours; cameras: img_id, R, t; optics: focal, cx, cy. A
    voxel asks the pixel nearest to its projection; its distance is the pixel's depth less its own, at most
    trunc, and divided by it. Depths that are null, not positive or farthest and beyond count as unseen.
    """
    numbers = [F.col(c).cast("double").alias(c) for c in ("u", "v", "d", *colours)]
    seen = pixels.where((F.col("d") > 0) & (F.col("d") < farthest) & F.col("u").isNotNull() & F.col("v").isNotNull()).select("img_id", *numbers)
    posed = seen.unionByName(cameras.select("img_id", "R", "t"), allowMissingColumns=True)
    # an image's camera comes first and its pixels follow, so that one task sees them whole and adds up those of its images
    posed = posed.repartition("img_id").sortWithinPartitions("img_id", F.col("R").isNull())
    sums = posed.mapInArrow(_fused(optics, voxel, trunc, colours), ", ".join(f"{c} long" for c in (*AXES, "weight", "tsdf", *colours)))
    sums = sums.groupBy(*AXES).agg(*(F.sum(c).alias(c) for c in ("weight", "tsdf", *colours)))
    return sums.select(*AXES, "weight", *((F.col(c) / F.col("weight") / STEPS).alias(c) for c in ("tsdf", *colours)))


def _whole(x: np.ndarray) -> np.ndarray:
    """Halves go away from zero, as in SQL."""
    if not np.isfinite(x).all():
        raise ValueError("distances and colours must be finite")
    down = np.trunc(x)
    return down + np.sign(x) * (np.abs(x - down) >= 0.5)


class _Sums:
    """Of blocks of voxels: how many pixels each voxel has met, its summed distance, and for each colour its sum and how many pixels have one."""

    def __init__(self, colours: tuple[str, ...]) -> None:
        self.colours, self.at = colours, {}
        self.rows = np.zeros((64, 2 + 2 * len(colours), SIDE**3), np.int64)

    def add(self, blocks: np.ndarray, sums: np.ndarray) -> None:
        own = np.array([self.at.setdefault(tuple(b), len(self.at)) for b in blocks.tolist()])
        if len(self.at) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(len(self.rows), len(self.at)), *self.rows.shape[1:]), np.int64)])
        self.rows[own] += sums

    def drain(self) -> Iterator[pa.RecordBatch]:
        blocks, rows = np.array(list(self.at), np.int64).reshape(-1, 3), self.rows[: len(self.at)]
        for k in range(0, len(blocks), 64):
            b, n = np.nonzero(rows[k : k + 64, 0])
            index = blocks[k + b] * SIDE + INSIDE[n]
            part = rows[k + b, :, n]
            more = [pa.array(part[:, 2 + 2 * c], mask=part[:, 3 + 2 * c] == 0) for c in range(len(self.colours))]
            columns = [*map(pa.array, index.T), pa.array(part[:, 0]), pa.array(part[:, 1]), *more]
            yield pa.RecordBatch.from_arrays(columns, names=[*AXES, "weight", "tsdf", *self.colours])
        self.__init__(self.colours)


def touched_blocks(r: np.ndarray, t: np.ndarray, u: np.ndarray, v: np.ndarray, d: np.ndarray, optics: Optics, voxel: float, trunc: float) -> np.ndarray:
    """Blocks (n x 3) that the rays of an image's pixels cross within trunc of the depth."""
    size, (focal, cx, cy) = voxel * SIDE, optics
    reach = max(1, int(np.ceil(2 * trunc / size)))
    found = []
    for k in range(2 * reach + 1):
        z = np.maximum(d + (-trunc + 2 * trunc * k / (2 * reach)), 0.0)
        x, y, z = (u - cx) * z / focal - t[0], (v - cy) * z / focal - t[1], z - t[2]
        found.append(np.unique(np.floor(np.column_stack([r[i] * x + r[3 + i] * y + r[6 + i] * z for i in range(3)]) / size).astype(np.int64), axis=0))
    return np.unique(np.concatenate(found), axis=0)


def _met(sums: _Sums, image: dict[str, np.ndarray], optics: Optics, voxel: float, trunc: float) -> Iterator[pa.RecordBatch]:
    """Adds what one image's pixels say of the voxels of its blocks; sums that are too many go on."""
    (focal, cx, cy), r, t = optics, image["R"], image["t"]
    blocks = touched_blocks(r, t, image["u"], image["v"], image["d"], optics, voxel, trunc)
    pu, pv = image["u"].astype(np.int64), image["v"].astype(np.int64)
    left, low, wide = pu.min(), pv.min(), pu.max() - pu.min() + 1
    order = np.argsort((pv - low) * wide + pu - left, kind="stable")
    keys = ((pv - low) * wide + pu - left)[order]
    for k in range(0, len(blocks), BLOCKS):
        some = blocks[k : k + BLOCKS]
        p = ((some * SIDE)[:, None, :] + INSIDE).reshape(-1, 3).T * voxel
        q = [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] + t[i] for i in range(3)]
        at = np.flatnonzero(q[2] > 0)
        x, y, z = (c[at] for c in q)
        u, v = np.floor(x / z * focal + cx + 0.5), np.floor(y / z * focal + cy + 0.5)
        near = (u >= left) & (u < left + wide) & (v >= low) & (v <= pv.max())
        at, z, key = at[near], z[near], (v[near].astype(np.int64) - low) * wide + u[near].astype(np.int64) - left
        first = np.searchsorted(keys, key)
        many = np.searchsorted(keys, key, side="right") - first
        at, z = np.repeat(at, many), np.repeat(z, many)
        pixel = order[np.repeat(first, many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
        sdf = image["d"][pixel] - z
        good = sdf >= -trunc
        at, pixel, sdf = at[good], pixel[good], sdf[good]
        count = lambda at, x=None: np.bincount(at, x, len(some) * SIDE**3).astype(np.int64).reshape(len(some), SIDE**3)
        rows = [count(at), count(at, _whole(np.minimum(1.0, sdf / trunc) * STEPS))]
        for c in image["colours"]:
            there = ~np.isnan(c[pixel])
            rows += [count(at[there], _whole(c[pixel][there] * STEPS)), count(at[there])]
        sums.add(some, np.stack(rows, axis=1))
        if len(sums.at) > HELD:
            yield from sums.drain()


def _fused(optics: Optics, voxel: float, trunc: float, colours: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pixels with their cameras, image by image: sums of voxels."""
    names = ["img_id", "u", "v", "d", *colours, "R", "t"]

    def meet(sums: _Sums, table: pa.Table) -> Iterator[pa.RecordBatch]:
        flat = lambda c: table.column(c).combine_chunks()
        poses = table.filter(table.column("R").is_valid()).select(["R", "t"]).to_pylist()
        table = table.filter(table.column("d").is_valid()).drop_columns(["R", "t"])
        image = {c: np.array(flat(c)) for c in ("u", "v", "d")} | {"colours": [np.array(flat(c).fill_null(np.nan)) for c in colours]}
        for pose in poses if len(table) else []:
            yield from _met(sums, image | pose, optics, voxel, trunc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, pieces = _Sums(colours), []
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch]).select(names)
            ids = table.column("img_id").to_pandas().to_numpy()
            for a, b in itertools.pairwise([0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]):
                if pieces and pieces[-1].column("img_id")[-1] != table.column("img_id")[a]:
                    yield from meet(sums, pa.concat_tables(pieces))
                    pieces = []
                pieces.append(table.slice(a, b - a))
        if pieces:
            yield from meet(sums, pa.concat_tables(pieces))
        yield from sums.drain()

    return run


def _neighbours(volume: DataFrame, masks: tuple[int, ...], colours: tuple[str, ...]) -> DataFrame:
    """Pairs of voxels whose distances differ in sign, each with the one in the direction of a mask: bit k is a step along axis k."""
    near = volume.select(*AXES, "tsdf", *colours).withColumn("mask", F.explode(F.array(*map(F.lit, masks))))
    ends = volume.select(*AXES, F.col("tsdf").alias("other"), *(F.col(c).alias(f"other_{c}") for c in colours)).withColumn("mask", F.explode(F.array(*map(F.lit, masks))))
    ends = ends.select(*((F.col(a) - F.shiftright("mask", k) % 2).alias(a) for k, a in enumerate(AXES)), "mask", "other", *(f"other_{c}" for c in colours))
    return near.join(ends, [*AXES, "mask"]).where((F.col("tsdf") < 0) != (F.col("other") < 0))


def extract_points(volume: DataFrame, voxel: float, colours: tuple[str, ...] = ()) -> DataFrame:
    """x, y, z and colours of the zero crossings between neighbours along the axes."""
    d = _neighbours(volume, (1, 2, 4), colours).withColumn("share", F.col("tsdf") / (F.col("tsdf") - F.col("other")))
    at = [((F.col(a) + F.when(F.col("mask") == 1 << k, F.col("share")).otherwise(0.0)) * voxel).alias(a[1]) for k, a in enumerate(AXES)]
    return d.select(*at, *((F.col(c) + F.col("share") * (F.col(f"other_{c}") - F.col(c))).alias(c) for c in colours))


def cases() -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(tetrahedron, pattern, number, edges): the triangles that part a tetrahedron's corners by their signs.

    A cube falls into six tetrahedra along its diagonal, each a path of steps along the axes in one order;
    corner i of a path is a mask of the axes already gone. Bit i of a pattern is set where corner i lies
    inside. An edge is 8 times its lower mask plus the mask of its direction. Triangles are turned so that
    their normal points outside.
    """
    place = lambda mask: np.array([mask >> k & 1 for k in range(3)], float)
    out = []
    for t, order in enumerate(itertools.permutations(range(3))):
        path = [0]
        for axis in order:
            path.append(path[-1] | 1 << axis)
        for pattern in range(1, 15):
            inner, outer = [i for i in range(4) if pattern >> i & 1], [i for i in range(4) if not pattern >> i & 1]
            if len(inner) == 2:
                ring = [(inner[0], outer[0]), (inner[0], outer[1]), (inner[1], outer[1]), (inner[1], outer[0])]
                triangles = [ring[:3], [ring[0], *ring[2:]]]
            else:
                lone, rest = (inner[0], outer) if len(inner) == 1 else (outer[0], inner)
                triangles = [[(lone, i) for i in rest]]
            outward = sum(place(path[i]) for i in outer) / len(outer) - sum(place(path[i]) for i in inner) / len(inner)
            for n, triangle in enumerate(triangles):
                a, b, c = ((place(path[i]) + place(path[j])) / 2 for i, j in triangle)
                edges = [(path[min(i, j)], path[min(i, j)] ^ path[max(i, j)]) for i, j in triangle]
                if np.dot(np.cross(b - a, c - a), outward) < 0:
                    edges = edges[::-1]
                out.append((t, pattern, n, tuple(8 * low + way for low, way in edges)))
    return out


def _vertex(edge: Column) -> Column:
    """The number of an edge of a cube (ix, iy, iz): its lower voxel and its direction."""
    low = F.floor(edge / 8).cast("int")
    number = F.lit(0).cast("long")
    for k, a in enumerate(AXES):
        number = number * (2 * MOST_INDEX) + F.col(a) + F.shiftright(low, k) % 2 + MOST_INDEX
    return number * 8 + edge % 8


def extract_mesh(volume: DataFrame, voxel: float) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices): fid, a, b, c and vid, x, y, z of the zero surface, by marching tetrahedra.

    Only cubes all of whose corners are known have faces. Vertices are named by the grid edge on which they
    lie, so neighbouring cubes share them. Faces are turned towards positive distances. Indices beyond
    MOST_INDEX raise an error.
    """
    checked = volume.select(*AXES, F.when(F.greatest(*(F.abs(a) for a in AXES)) < MOST_INDEX - 1, F.col("tsdf")).otherwise(F.raise_error("the volume has too many voxels along an axis")).alias("tsdf"))
    checked = materialize(checked, "volume")
    corner = checked.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(7))))
    cube = corner.select(*((F.col(a) - F.shiftright("mask", k) % 2).alias(a) for k, a in enumerate(AXES)), "mask", "tsdf")
    cube = cube.groupBy(*AXES).agg(F.bit_or(F.when(F.col("tsdf") < 0, F.expr("shiftleft(1, mask)")).otherwise(0)).alias("inside"), F.count("*").alias("known"))
    cube = cube.where("known = 8 AND inside BETWEEN 1 AND 254").select(*AXES, "inside")
    paths = list(itertools.permutations(range(3)))
    bit = lambda mask: F.shiftright("inside", mask) % 2
    patterns = []
    for order in paths:
        masks = [0, 1 << order[0], 1 << order[0] | 1 << order[1], 7]
        patterns.append(sum((bit(m) * (1 << i) for i, m in enumerate(masks[1:], 1)), bit(masks[0])).cast("int"))
    tets = cube.select(*AXES, F.posexplode(F.array(*patterns)).alias("tet", "pattern"))
    table = volume.sparkSession.createDataFrame([(t, p, n, list(e)) for t, p, n, e in cases()], "tet int, pattern int, number int, edges array<int>")
    rows = tets.join(F.broadcast(table), ["tet", "pattern"])
    faces = rows.select(*(_vertex(F.col("edges")[i]).alias(c) for i, c in enumerate("abc")))
    faces = materialize(faces.withColumn("fid", F.monotonically_increasing_id()).select("fid", "a", "b", "c"), "faces")
    ends = _neighbours(checked, tuple(range(1, 8)), ()).withColumn("share", F.col("tsdf") / (F.col("tsdf") - F.col("other")))
    at = [((F.col(a) + F.shiftright("mask", k) % 2 * F.col("share")) * voxel).alias(a[1]) for k, a in enumerate(AXES)]
    points = ends.select(_vertex(F.col("mask")).alias("vid"), *at)
    used = faces.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    return faces, materialize(points.join(used, "vid", "left_semi"), "vertices")


def fuse(pixels: DataFrame, cameras: DataFrame, optics: Optics, voxel: float = 0.005, trunc: float = 0.04, farthest: float = 5.0, colours: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, faces, vertices) of all depth maps in one volume."""
    volume = materialize(integrate(pixels, cameras, optics, voxel, trunc, farthest, colours), "volume")
    return extract_points(volume, voxel, colours), *extract_mesh(volume, voxel)
