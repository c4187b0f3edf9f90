"""Small dense problems that expressions can't state: batched linear algebra over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.linear import vec


def _two_view(p1: np.ndarray, p2: np.ndarray, uv: np.ndarray) -> np.ndarray:
    """Linear triangulation of n points from n pairs of 3x4 projections and (u1, v1, u2, v2)."""
    a = np.stack([uv[:, 0, None] * p1[:, 2] - p1[:, 0], uv[:, 1, None] * p1[:, 2] - p1[:, 1], uv[:, 2, None] * p2[:, 2] - p2[:, 0], uv[:, 3, None] * p2[:, 2] - p2[:, 1]], axis=1)
    x = np.linalg.svd(a)[2][:, -1]
    w = np.where(np.abs(x[:, 3]) < 1e-12, np.nan, x[:, 3])
    return x[:, :3] / w[:, None]


def _flat(*arrays: tuple[pa.Array, int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows have all numbers of all columns of lists of so many, and these rows' numbers."""
    whole = np.logical_and.reduce([np.asarray(a.is_valid()) for a, _ in arrays])
    flat = [np.asarray(a.filter(pa.array(whole)).flatten().fill_null(np.nan), float).reshape(-1, n) for a, n in arrays]
    known = np.logical_and.reduce([np.isfinite(a).all(axis=1) for a in flat])
    whole[whole] = known
    return whole, [a[known] for a in flat]


def _lists(known: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Rows of numbers where known, else null: offsets that are null make null lists."""
    ends = np.concatenate([[0], np.cumsum(rows.shape[1] * known)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~known, False)), pa.array(rows.ravel()))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _triangulated(p1: pa.Array, p2: pa.Array, uv: pa.Array) -> pa.Array:
    whole, (a, b, at) = _flat((p1, 12), (p2, 12), (uv, 4))
    x = np.full((len(whole), 3), np.nan)
    if len(at):
        x[whole] = _two_view(a.reshape(-1, 3, 4), b.reshape(-1, 3, 4), at)
    good = np.isfinite(x).all(axis=1)
    return _lists(good, x[good])


def triangulate(p1: Column, p2: Column, u1: Column, v1: Column, u2: Column, v2: Column) -> Column:
    """World point of two pixels under two projection matrices (12 numbers each); null at infinity."""
    return _triangulated(p1, p2, vec(u1, v1, u2, v2))


@F.arrow_udf(T.BooleanType())
def _good(x: pa.Array, pose1: pa.Array, pose2: pa.Array, more: pa.Array) -> pa.Array:
    whole, (at, a, b, m) = _flat((x, 3), (pose1, 12), (pose2, 12), (more, 15))
    good, ways = np.ones(len(at), bool), []
    with np.errstate(all="ignore"):
        for pose, seen in ((a, m[:, :2]), (b, m[:, 2:4])):
            r, t = pose[:, :9].reshape(-1, 3, 3), pose[:, 9:]
            q = np.einsum("nij,nj->ni", r, at) + t
            u, v = m[:, 6] * q[:, 0] / q[:, 2] + m[:, 8], m[:, 10] * q[:, 1] / q[:, 2] + m[:, 11]
            good &= (q[:, 2] > 0) & (np.hypot(u - seen[:, 0], v - seen[:, 1]) < m[:, 4])
            ways.append(at + np.einsum("nij,ni->nj", r, t))
        p, q = ways
        cosine = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
        good &= np.degrees(np.arccos(np.clip(cosine, -1, 1))) >= m[:, 5]
    whole[whole] = good
    return pa.array(whole)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _pixels(p: pa.Array, pose: pa.Array, k: pa.Array) -> pa.Array:
    whole, (x, a, c) = _flat((p, 3), (pose, 12), (k, 9))
    q = np.einsum("nij,nj->ni", a[:, :9].reshape(-1, 3, 3), x) + a[:, 9:]
    ahead = q[:, 2] > 0
    whole[whole] = ahead
    q, c = q[ahead], c[ahead]
    return _lists(whole, np.column_stack([c[:, 0] * (q[:, 0] / q[:, 2]) + c[:, 2], c[:, 4] * (q[:, 1] / q[:, 2]) + c[:, 5]]))


def pixels(rows: DataFrame, k: Column) -> DataFrame:
    """Adds u, v: the pixels of world points (p) under cameras (R, t); rows whose point isn't ahead go. Batches of rows, for the reason of good_points()."""
    d = rows.withColumn("_uv", _pixels(F.col("p"), F.concat("R", "t"), k)).where("_uv IS NOT NULL")
    return d.select(*rows.columns, F.col("_uv")[0].alias("u"), F.col("_uv")[1].alias("v"))


def good_points(rows: DataFrame, k: Column, pixels: float = 4.0, degrees: float = 2.0) -> DataFrame:
    """Triangulated rows (x; R1, t1, u1, v1; R2, t2, u2, v2) in front of both cameras, near both pixels, seen at an angle.

    Batches of rows meet the tests: as expressions these are one filter of several thousand characters, which takes the JVM some 100 us a row.
    """
    more = F.concat(vec(F.col("u1"), F.col("v1"), F.col("u2"), F.col("v2"), pixels, degrees), k)
    return rows.where(_good(F.col("x"), *(F.concat(f"R{n}", f"t{n}") for n in (1, 2)), more))


def _similarity(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out, by = [], [c for c in b.columns if c not in ("n", "cov", "var", "mean_from", "mean_to")]
        for r in b.itertuples():
            cov = np.array(r.cov).reshape(3, 3)
            u, d, vt = np.linalg.svd(cov)
            sign = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
            rot = u @ sign @ vt
            scale = float(np.trace(np.diag(d) @ sign) / r.var) if r.var > 0 else 1.0
            out.append((int(r.n), scale, rot.ravel().tolist(), (np.array(r.mean_to) - scale * rot @ np.array(r.mean_from)).tolist()))
        yield pd.concat([b[by].reset_index(drop=True), pd.DataFrame(out, columns=["n", "scale", "R", "t"])], axis=1)


def align_similarity(pairs: DataFrame, start: tuple[str, str, str], goal: tuple[str, str, str], by: str | None = None) -> DataFrame:
    """n, scale, R, t of the similarity that takes start columns to goal columns with least squares; of each value of a whole-numbered column by, if given.

    Means and covariances come from two aggregates over all rows; one row reaches the 3x3 decomposition.
    """
    groups = [by] if by else []
    means = pairs.groupBy(*groups).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"_m{k}") for k, c in enumerate((*start, *goal))))
    d = pairs.join(means, by) if by else pairs.crossJoin(F.broadcast(means))
    at = [F.col(c) - F.col(f"_m{k}") for k, c in enumerate((*start, *goal))]
    one = d.groupBy(*groups).agg(F.first("n").alias("n"), F.array(*(F.avg(at[3 + i] * at[j]) for i in range(3) for j in range(3))).alias("cov"), F.avg(at[0] * at[0] + at[1] * at[1] + at[2] * at[2]).alias("var"), F.array(*(F.first(f"_m{k}") for k in range(3))).alias("mean_from"), F.array(*(F.first(f"_m{k}") for k in range(3, 6))).alias("mean_to"))
    return one.where("n > 0").mapInPandas(_similarity, (f"{by} long, " if by else "") + "n long, scale double, R array<double>, t array<double>")
