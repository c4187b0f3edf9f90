"""Descriptor matching between images: exact nearest neighbours, an approximate index, a ratio test and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .two_view import verified_matches

#: Features to a block, on average; products of queries and features that a task holds at once, and the lists of features of which least products are kept.
BLOCK, BLOCK_VALUES, LISTS = 50_000, 4_000_000, 32
#: Pairs of blocks that are broadcast, at most.
FEW_PAIRS = 500_000
#: Pairs of codes that a task compares at once.
LEAST_BITS = 200_000


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    """Of descriptors packed into longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of rows i of x and j of y, by differences."""
    step = max(1, BLOCK_VALUES // x.shape[1])
    return np.concatenate([((x[i[k : k + step]] - y[j[k : k + step]]) ** 2).sum(axis=1) for k in range(0, len(i), step)] or [np.zeros(0)])


def _two_first(q: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of each query's two least, of equals the first features."""
    order = np.lexsort((j, d, q))
    q = q[order]
    return order[np.append([True, True], q[2:] != q[:-2])[: len(q)]]


def _near(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, squared distance) of the two rows of y nearest to each row of x.

    Products bound all distances, by their own rounding errors; differences tell only those apart that may be among the two.
    """
    n, dim = y.shape
    most = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0))
    if not most < 1e150:  # no bounds: differences alone
        step = max(1, BLOCK_VALUES // y.size)
        for k in range(0, len(x), step):
            d = ((x[k : k + step, None, :] - y[None, :, :]) ** 2).sum(axis=2)
            for _ in range(min(2, n)):
                best = d.argmin(axis=1)
                at = np.arange(len(d))
                yield k + at, best, d[at, best]
                d[at, best] = np.inf
        return
    kind = np.float32 if most < 1e15 else np.float64
    # copies are no third nearest: the first two of equal rows stay
    _, same = np.unique(np.ascontiguousarray(y).view(np.dtype((np.void, dim * 8))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    kept = np.sort(order[np.append([True, True], same[order][2:] != same[order][:-2])[:n]])
    y = y[kept]
    lists = -(-len(y) // LISTS)
    yy, xx = (y * y).sum(axis=1), (x * x).sum(axis=1)
    right = np.zeros((dim + 1, LISTS * lists), kind)
    right[:dim, : len(y)], right[dim] = y.T, np.inf
    right[dim, : len(y)] = yy
    error = 16 * (dim + 4) * np.finfo(kind).eps * (xx + yy.max()) + dim * 1e-36
    step = max(1, BLOCK_VALUES // right.shape[1])
    for k in range(0, len(x), step):
        left = np.ones((len(x[k : k + step]), dim + 1), kind)
        left[:, :dim] = -2 * x[k : k + step]
        g = (left @ right).reshape(len(left), LISTS, lists)
        least = g.min(axis=1)
        bound = np.partition(least, 1, axis=1)[:, 1] + error[k : k + step] if lists > 1 else np.full(len(left), np.inf)
        i, c = np.nonzero(least <= bound[:, None])
        step_in = max(1, BLOCK_VALUES // LISTS)
        found = []
        for m in range(0, len(i), step_in):
            a, b = i[m : m + step_in], c[m : m + step_in]
            at, w = np.nonzero(g[a, :, b] <= bound[a][:, None])
            q, j = a[at], w * lists + b[at]
            q, j = q[j < len(y)], j[j < len(y)]
            d = _exact(x[k : k + step], y, q, j)
            top = _two_first(q, j, d)
            found.append((q[top], j[top], d[top]))
        q, j, d = (np.concatenate(f) for f in zip(*found, strict=True))
        top = _two_first(q, j, d)
        yield k + q[top], kept[j[top]], d[top]


def _least_two(a: pa.Table, b: pa.Table, keep: tuple[str, ...] = ()) -> pa.Table:
    """Of a block of queries and a block of an image: each query's two nearest, by exact differences, and what to keep of both."""
    schema = pa.schema([("query_idx", pa.int64()), ("train_idx", pa.int64()), ("d", pa.float64()), *((f"{c}{k}", pa.float64()) for k in (1, 2) for c in keep)])
    if not len(a) or not len(b):
        return schema.empty_table()
    b = b.sort_by("train_idx")
    x, y = (np.array(t.column("desc").combine_chunks().flatten(), float).reshape(len(t), -1) for t in (a, b))
    q, t, d = (np.concatenate(c) for c in zip(*_near(x, y), strict=True))
    of = [(a, "query_idx", q), (b, "train_idx", t)]
    return pa.Table.from_arrays([*(r.column(c).combine_chunks().take(pa.array(i)) for r, c, i in of), pa.array(d), *(r.column(c).combine_chunks().take(pa.array(i)) for r, _, i in of for c in keep)], schema=schema)


def _block_pairs(queries: DataFrame, features: DataFrame, values: str, block: int, image_pairs: DataFrame | None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Queries (query_idx) and features (train_idx) for each pair of blocks (img_a, part_a, img_b, part_b) that meets, of images a < b or of image_pairs."""
    of = lambda d: d.groupBy("img_id").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    parts_q, parts_f = of(queries), of(features)
    dealt = lambda d, parts: d.join(F.broadcast(parts), "img_id").withColumn("part", F.pmod(F.xxhash64("feat_id"), F.col("parts")).cast("int"))
    blocks_a = parts_q.select(F.col("img_id").alias("img_a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part_a"))
    blocks_b = parts_f.select(F.col("img_id").alias("img_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part_b"))
    pairs = blocks_a.join(blocks_b, F.col("img_a") < F.col("img_b")) if image_pairs is None else blocks_a.join(image_pairs.select("img_a", "img_b").distinct(), "img_a").join(blocks_b, "img_b")
    if pairs.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS:  # features then travel once, to where their pair meets
        pairs = F.broadcast(pairs)
    place = ["img_a", "part_a", "img_b", "part_b"]
    left = dealt(queries, parts_q).withColumnsRenamed({"img_id": "img_a", "part": "part_a"}).join(pairs, ["img_a", "part_a"])
    right = dealt(features, parts_f).withColumnsRenamed({"img_id": "img_b", "part": "part_b"}).join(pairs, ["img_b", "part_b"])
    # each side has columns of its own: both come from the same features
    return tuple(d.select(*place, F.col("feat_id").cast("long"), values, *(F.col(x).cast("double") for x in keep)).toDF(*place, c, values, *keep) for d, c in ((left, "query_idx"), (right, "train_idx")))


def _placed(found: pa.Table, key: tuple) -> pa.Table:
    for k, name in ((2, "img_b"), (0, "img_a")):
        found = found.add_column(0, name, pa.array([key[k].as_py()] * len(found), pa.int64()))
    return found


PLACE = ("img_a", "part_a", "img_b", "part_b")


def nearest_two(features: DataFrame, queries: DataFrame | None = None, block: int = BLOCK, image_pairs: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """img_a, img_b, query_idx, train_idx, d1, d2: each feature of image a with its nearest in each image b > a, or in those of image_pairs (img_a, img_b).

    Features are dealt into blocks of bounded size, and block pairs of two images compared whole, so that
    a large image is many tasks. Of each block pair the least two of each query go on, and of these the
    least two are kept. Ties go to the smaller train_idx. Columns to keep (numbers) follow as doubles: u gives u1 and u2.
    """
    left, right = _block_pairs(queries if queries is not None else features, features, "desc", block, image_pairs, keep)
    more = [f"{c}{k}" for k in (1, 2) for c in keep]
    near = left.groupBy(*PLACE).cogroup(right.groupBy(*PLACE)).applyInArrow(lambda key, a, b: _placed(_least_two(a, b, keep), key), "img_a long, img_b long, query_idx long, train_idx long, d double" + "".join(f", {c} double" for c in more))
    # of two for each block only the least two count
    x = F.struct("d", "train_idx", *more)
    rank = Window.partitionBy("img_a", "img_b", "query_idx").orderBy("d", "train_idx")
    top = near.withColumn("rank", F.row_number().over(rank)).where("rank <= 2").withColumn("x", x)
    top = top.groupBy("img_a", "img_b", "query_idx").agg(F.min("x").alias("first"), F.max("x").alias("second"), F.count("*").alias("n")).where("n = 2")
    kind = features.schema["img_id"].dataType
    return top.select(F.col("img_a").cast(kind).alias("img_a"), F.col("img_b").cast(kind).alias("img_b"), "query_idx", F.col("first.train_idx").alias("train_idx"), F.sqrt("first.d").alias("d1"), F.sqrt("second.d").alias("d2"), *(F.col(f"first.{c}").alias(c) for c in more))


def nearest_bits(features: DataFrame, image_pairs: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """img_a, img_b, query_idx, least: the differing bits of each feature (img_id, feat_id, bits: longs) and the nearest in image b.

    Blocks meet as in nearest_two(); equal codes of a block are compared once.
    """

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            least, q = np.zeros(0, np.int32), pa.array([], pa.int64())
        else:
            codes = [np.array(t.column("bits").combine_chunks().flatten(), np.int64).view(np.uint64).reshape(len(t), -1) for t in (a, b)]
            (x, back), y = np.unique(codes[0], axis=0, return_inverse=True), np.unique(codes[1], axis=0)
            step, best = max(1, LEAST_BITS // len(y)), []
            for k in range(0, len(x), step):
                d = sum(np.bitwise_count(x[k : k + step, w, None] ^ y[None, :, w]).astype(np.uint8 if x.shape[1] < 4 else np.int32) for w in range(x.shape[1]))
                best.append(d.min(axis=1))
            least, q = np.concatenate(best)[back.ravel()].astype(np.int32), a.column("query_idx").combine_chunks()
        return _placed(pa.table({"query_idx": q, "least": pa.array(least, pa.int32())}), key)

    left, right = _block_pairs(features, features, "bits", block, image_pairs)
    near = left.groupBy(*PLACE).cogroup(right.groupBy(*PLACE)).applyInArrow(run, "img_a long, img_b long, query_idx long, least int")
    return near.groupBy("img_a", "img_b", "query_idx").agg(F.min("least").alias("least"))


#: Tables of the index, bits of a key, and uncertain bits that a query also asks the other way.
TABLES, KEY_BITS, PROBES = 8, 10, 4


def _keys(tables: int, bits: int, probes: int, seed: int, packed: bool):
    """Of features: for each table a key of signs of random projections, or of random bits of packed descriptors, and the keys near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = np.array(batch.column("desc").flatten()).reshape(n, -1)
            rng = np.random.default_rng(seed)
            if packed:
                own = np.unpackbits(x.astype(np.int64).view(np.uint8).reshape(n, -1), axis=1).astype(float) - 0.5
                near = own[:, rng.choice(own.shape[1], (tables, min(bits, own.shape[1])))]
            else:
                near = np.einsum("nd,tdb->ntb", x.astype(float), rng.normal(size=(tables, x.shape[1], bits)))
            power = 1 << np.arange(near.shape[2], dtype=np.int64)
            key = (near > 0) @ power
            flips = np.argsort(np.abs(near), axis=2, kind="stable")[:, :, :probes]
            for t in range(tables):
                keys = np.concatenate([key[:, t, None], key[:, t, None] ^ power[flips[:, t]]], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("img_id"), batch.column("feat_id"), pa.array(np.full(n, t, np.int32)), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["img_id", "feat_id", "table", "keys"])

    return run


def index_keys(features: DataFrame, tables: int = TABLES, bits: int = KEY_BITS, probes: int = PROBES, seed: int = 0, packed: bool = False) -> DataFrame:
    """img_id, feat_id, table, keys: the bucket of each feature in each table, and behind it those beside which it nearly fell."""
    d = features.select(F.col("img_id").cast("long").alias("img_id"), F.col("feat_id").cast("long").alias("feat_id"), "desc")
    return d.mapInArrow(_keys(tables, bits, probes, seed, packed), "img_id long, feat_id long, table int, keys array<long>")


def candidate_images(features: DataFrame, least: int = 10, **index) -> DataFrame:
    """img_a, img_b, shared of pairs of images whose features share buckets often enough: a feature counts once for each table."""
    keys = index_keys(features, probes=0, **index).select("img_id", "table", F.col("keys")[0].alias("key"))
    n = keys.groupBy("table", "key", "img_id").agg(F.count("*").alias("n"))
    a, b = n.withColumnsRenamed({"img_id": "img_a", "n": "n_a"}), n.withColumnsRenamed({"img_id": "img_b", "n": "n_b"})
    both = a.join(b, ["table", "key"]).where("img_a < img_b").groupBy("img_a", "img_b").agg(F.sum(F.least("n_a", "n_b")).alias("shared"))
    return both.where(F.col("shared") >= least)


def candidates(features: DataFrame, **index) -> DataFrame:
    """img_a, img_b, query_idx, train_idx: features of two images that meet in a bucket of some table."""
    keys = index_keys(features, **index)
    a = keys.select(F.col("img_id").alias("img_a"), F.col("feat_id").alias("query_idx"), "table", F.explode("keys").alias("key"))
    b = keys.select(F.col("img_id").alias("img_b"), F.col("feat_id").alias("train_idx"), "table", F.col("keys")[0].alias("key"))
    return a.join(b, ["table", "key"]).where("img_a < img_b").select("img_a", "img_b", "query_idx", "train_idx").distinct()


def nearest_two_indexed(features: DataFrame, packed: bool = False, **index) -> DataFrame:
    """What nearest_two() gives, by the index: the nearest two that meet the feature in a bucket, at their exact distances.

    nearest_two() is the exact way. Distances of packed descriptors are differing bits.
    """
    ends = features.select(F.col("img_id").cast("long").alias("img"), F.col("feat_id").cast("long").alias("feat"), "desc")
    d = candidates(features, packed=packed, **index)
    d = d.join(ends.toDF("img_a", "query_idx", "desc_a"), ["img_a", "query_idx"]).join(ends.toDF("img_b", "train_idx", "desc_b"), ["img_b", "train_idx"])
    far = hamming(F.col("desc_a"), F.col("desc_b")).cast("double") if packed else F.sqrt(squared_distance(F.col("desc_a"), F.col("desc_b")))
    d = d.select("img_a", "img_b", "query_idx", F.struct(far.alias("d"), "train_idx").alias("x"))
    rank = Window.partitionBy("img_a", "img_b", "query_idx").orderBy("x")
    top = d.withColumn("rank", F.row_number().over(rank)).where("rank <= 2").groupBy("img_a", "img_b", "query_idx").agg(F.min("x").alias("first"), F.max("x").alias("second"), F.count("*").alias("n")).where("n = 2")
    return top.select("img_a", "img_b", "query_idx", F.col("first.train_idx").alias("train_idx"), F.col("first.d").alias("d1"), F.col("second.d").alias("d2"))


def ratio_test(pairs: DataFrame, ratio: float = 0.75, min_matches: int = 1) -> DataFrame:
    """Matches clearly nearer than the runner-up, of image pairs that have enough of them."""
    kept = pairs.where(F.col("d1") < ratio * F.col("d2"))
    if min_matches <= 1:
        return kept
    kept = materialize(kept, "matches")  # counted and kept from one search
    enough = kept.groupBy("img_a", "img_b").count().where(F.col("count") >= min_matches).select("img_a", "img_b")
    return kept.join(enough, ["img_a", "img_b"], "left_semi")


def match_images(features: DataFrame, pairs: DataFrame, ratio: float = 0.75, threshold: float = 3.0, min_matches: int = 30) -> DataFrame:
    """img_a, img_b, query_idx, train_idx, u1, v1, u2, v2, inlier of all matches of pairs that keep min_matches inliers.

    features: img_id, feat_id, u, v; pairs: what nearest_two() or the index gives, with the pixels where it kept u and v.
    Matches pass the ratio test and are verified by the pair's epipolar geometry; pairs with fewer than min_matches
    before or behind it go, where their matches meet.
    """
    d = ratio_test(pairs, ratio)
    if not {"u1", "v1", "u2", "v2"} <= set(d.columns):
        at = features.select("img_id", "feat_id", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
        d = d.join(at.toDF("img_a", "query_idx", "u1", "v1"), ["img_a", "query_idx"]).join(at.toDF("img_b", "train_idx", "u2", "v2"), ["img_b", "train_idx"])
    return verified_matches(d, threshold, ("query_idx", "train_idx"), min_matches)


def match_summary(matches: DataFrame) -> DataFrame:
    """num_matches, num_inliers and inlier_ratio of each image pair; without a mask all matches are inliers."""
    inlier = F.coalesce(F.col("inlier"), F.lit(True)) if "inlier" in matches.columns else F.lit(True)
    n = matches.groupBy("img_a", "img_b").agg(F.count("*").alias("num_matches"), F.count_if(inlier).alias("num_inliers"))
    return n.withColumn("inlier_ratio", F.coalesce(F.try_divide("num_inliers", "num_matches"), F.lit(0.0)))


def strongest(features: DataFrame, n: int, strength: str = "response") -> DataFrame:
    """At most n features of each image, the strongest first, ties by feat_id."""
    order = Window.partitionBy("img_id").orderBy(F.desc(strength), "feat_id")
    return features.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")
