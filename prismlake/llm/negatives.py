"""Hard negatives by a vertical scan of embeddings (branch and bound on dimensions).

Rows are packed into blocks of bounded size, a block's components dimension by dimension. An anchor
reads a block's dimensions in descending magnitude of its own components, a few at a time. What the
dimensions still unread can add lies between two sums of the block's least and largest components
(remaining bounds), so each candidate's score is known to lie in an interval; a bitmap tells who is
still in question, and shrinks until what is left is scored to the end. The first scan of an anchor asks
for its positives, the second for the best rows in each positive's window of scores.

Anchors meet all rows block by block: a stated set of queries against all rows. Each block pair hands on
no more than the best few of an anchor, or of its windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize

#: Rows to a block, on average, and dimensions read at once: few at first, when they tell most.
BLOCK = 4096
STEPS = (4, 4, 8, 16)
#: Scores stay below this magnitude, so that sums are exact.
MOST = 1 << 62

PACKED = "dim int, part int, n int, ids binary, labels binary, kind string, cols binary"
WINDOW = pa.struct([("positive_id", pa.int64()), ("score", pa.int64())])


def taking_part(embeddings: DataFrame, noise: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, v, dim of the rows that take part: whole numbers floor(256 x), labels with their planted noise.

    Rows with a null vec_id, label or vector, an empty vector, or a null or non-finite component take no part.
    """
    e = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0)
    finite = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    label = F.when(F.col("vec_id") % noise == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    d = embeddings.where(ok & finite)
    return d.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(e, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"), F.size(e).alias("dim"))


def _packed(dim: int, part: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> dict:
    """A block as one row: components by dimension, as the narrowest integers that hold them."""
    kind = next(k for k in ("i2", "i4", "i8") if len(v) == 0 or np.iinfo(k).min <= v.min() and v.max() <= np.iinfo(k).max)
    return {"dim": pa.array([dim], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()], "labels": [labels.tobytes()], "kind": [kind], "cols": [np.ascontiguousarray(v.T.astype(kind)).tobytes()]}


def _pack(key: tuple, t: pa.Table) -> pa.Table:
    dim, part = (k.as_py() for k in key)
    v = np.array(t.column("v").combine_chunks().flatten(), np.int64).reshape(len(t), dim)
    ids, labels = (np.array(t.column(c), np.int64) for c in ("vec_id", "label"))
    order = np.lexsort((*v.T[::-1], labels, ids))
    rows = np.column_stack([ids, labels, v])[order]
    order = order[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]  # a repeated row is one
    return pa.table(_packed(dim, part, ids[order], labels[order], v[order]))


class _Block:
    def __init__(self, t: pa.Table) -> None:
        r = t.to_pylist()[0]
        self.n, self.windows = r["n"], r.get("windows")
        self.ids, self.labels = (np.frombuffer(r[c], np.int64) for c in ("ids", "labels"))
        self.cols = np.frombuffer(r["cols"], r["kind"]).reshape(r["dim"], self.n)
        self.most = max(-int(self.cols.min()), int(self.cols.max()))

    def spread(self, kind: type) -> None:
        """Makes the components numbers of a kind in which sums are exact."""
        self.cols = self.cols.astype(kind)
        self.low, self.high = self.cols.min(axis=1), self.cols.max(axis=1)


class Scan:
    """One anchor's scan of one block: partial scores of the candidates that the bitmap still holds, and bounds of what remains."""

    def __init__(self, block: _Block, anchor: np.ndarray, candidates: np.ndarray) -> None:
        self.block, self.anchor = block, anchor
        self.order = np.argsort(-np.abs(anchor), kind="stable")
        x, y = anchor * block.low, anchor * block.high
        least, most = np.minimum(x, y)[self.order], np.maximum(x, y)[self.order]
        self.least, self.most = (np.concatenate([np.cumsum(b[::-1])[::-1], [0]]) for b in (least, most))
        self.read, self.at, self.partial = 0, np.flatnonzero(candidates), np.zeros(int(candidates.sum()), anchor.dtype)

    def steps(self):
        """Reads dimensions until none is left; the caller shrinks the candidates between two steps."""
        sizes = iter(STEPS)
        while self.read < len(self.order) and len(self.at):
            few = self.order[self.read : self.read + next(sizes, len(self.order))]
            self.partial = self.partial + self.anchor[few] @ (self.block.cols[few] if len(self.at) == self.block.n else self.block.cols[few[:, None], self.at])
            self.read += len(few)
            yield

    @property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return self.partial + self.least[self.read], self.partial + self.most[self.read]

    def keep(self, bitmap: np.ndarray) -> None:
        self.at, self.partial = self.at[bitmap], self.partial[bitmap]


def _largest(x: np.ndarray, k: int) -> int | None:
    return int(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else None


def _order(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, -scores))


def best_of(block: _Block, anchor: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k candidates of the highest scores, ties by smaller id."""
    scan = Scan(block, anchor, candidates)
    for _ in scan.steps():
        low, high = scan.bounds
        floor = _largest(low, k)  # k candidates reach it for sure
        if floor is not None:
            scan.keep(high >= floor)
    ids = block.ids[scan.at]
    order = _order(ids, scan.partial)[:k]
    return ids[order], scan.partial[order]


def in_windows(block: _Block, anchor: np.ndarray, candidates: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (low, high) of scores, ends included, (ids, scores) of the k best candidates in it."""
    scan = Scan(block, anchor, candidates)
    for _ in scan.steps():
        low, high = scan.bounds
        wanted = np.zeros(len(low), bool)
        for a, b in windows:
            floor = _largest(low[(low >= a) & (high <= b)], k)  # of those that are in it for sure
            wanted |= (high >= (a if floor is None else max(a, floor))) & (low <= b)
        scan.keep(wanted)
    ids, out = block.ids[scan.at], []
    for a, b in windows:
        inside = np.flatnonzero((scan.partial >= a) & (scan.partial <= b))
        inside = inside[_order(ids[inside], scan.partial[inside])[:k]]
        out.append((ids[inside], scan.partial[inside]))
    return out


def window(score: int, least: int, most: int) -> tuple[int, int]:
    """The whole scores x with least * score <= 100 x <= most * score."""
    return -(-least * score // 100), most * score // 100


def _met(anchors: pa.Table, rows: pa.Table) -> tuple[_Block, _Block]:
    a, b = _Block(anchors), _Block(rows)
    size = len(a.cols) * a.most * b.most
    if size >= MOST:
        raise OverflowError("scores need more than 64 bits")
    for block in (a, b):
        block.spread(np.float64 if size < 1 << 53 else np.int64)
    return a, b


def _positives(k: int):
    schema = {"anchor_id": pa.int64(), "anchor": pa.int64(), "positive_id": pa.int64(), "positive": pa.int64(), "score": pa.int64()}

    def run(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(anchors) and len(rows):
            a, b = _met(anchors, rows)
            for i in range(a.n):
                ids, scores = best_of(b, a.cols[:, i], (b.labels == a.labels[i]) & (b.ids != a.ids[i]), k)
                out += [(int(a.ids[i]), i, int(p), rank, int(s)) for rank, (p, s) in enumerate(zip(ids, scores, strict=True))]
        return pa.table([pa.array([r[c] for r in out], kind) for c, kind in enumerate(schema.values())], names=list(schema))

    return run, "anchor_id long, anchor long, positive_id long, positive long, score long"


def _negatives(k: int, least: int, most: int):
    names = ("anchor_id", "anchor", "positive_id", "place", "positive_score", "negative_id", "negative_score")

    def run(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(anchors) and len(rows):
            a, b = _met(anchors, rows)
            for i in range(a.n):
                asked = a.windows[i]
                found = in_windows(b, a.cols[:, i], (b.labels != a.labels[i]) & (b.ids != a.ids[i]), [window(w["score"], least, most) for w in asked], k)
                for place, (w, (ids, scores)) in enumerate(zip(asked, found, strict=True)):
                    out += [(int(a.ids[i]), i, w["positive_id"], place, w["score"], int(x), int(s)) for x, s in zip(ids, scores, strict=True)]
        return pa.table([pa.array([r[c] for r in out], pa.int64()) for c in range(len(names))], names=list(names))

    return run, ", ".join(f"{c} long" for c in names)


def _parts(count: int) -> int:
    return max(1, -(-count // BLOCK))


def _blocks(rows: DataFrame, count: int) -> DataFrame:
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(_parts(count))).cast("int"))
    return dealt.groupBy("dim", "part").applyInArrow(_pack, PACKED)


def _pairs(anchors: DataFrame, blocks: DataFrame, asked: int, count: int):
    """Every block of anchors with every block of rows, by keys: a block goes out once for each of the other side."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(_parts(n) - 1)))
    a = anchors.withColumnRenamed("part", "anchor_part").withColumn("row_part", each(count))
    b = blocks.withColumnRenamed("part", "row_part").withColumn("anchor_part", each(asked))
    keys = ["dim", "anchor_part", "row_part"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys))


def hard_negatives(rows: DataFrame, anchors: Column | None = None, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, v (whole numbers), dim, as taking_part() makes them. A row's score is its inner
    product with the anchor; higher ones come first, ties by smaller vec_id. An anchor's positives are its
    first other rows of the same label, all if fewer. Of each, the first rows of other labels whose score
    is least to most per cent of the positive's are returned; none where the positive's score is negative.
    Rows that repeat vec_id, label and vector are one; other rows that share an anchor's vec_id are neither
    positives nor negatives of it, but candidates of all others, each by itself. Vectors of different
    length don't meet. Scores that need more than 64 bits raise an error. An empty table gives an empty result.
    """
    scratch = Scratch(rows.sparkSession)
    rows = scratch.table(rows.select("vec_id", "label", "v", "dim"), "vectors")
    chosen = rows.where(anchors if anchors is not None else F.col("vec_id") % 50 == 0)
    count, asked = rows.count(), chosen.count()
    blocks, packed = scratch.table(_blocks(rows, count), "blocks"), scratch.table(_blocks(chosen, asked), "anchors")
    run, schema = _positives(positives)
    near = _pairs(packed, blocks, asked, count).applyInArrow(lambda k, a, b: _with_place(run(k, a, b), k), f"{schema}, dim int, part int")
    first = Window.partitionBy("dim", "part", "anchor").orderBy(F.desc("score"), "positive_id", "positive")
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    # an anchor's positives, in their order: as many as asked for at most
    asked_for = near.where("score >= 0").groupBy("dim", "part", "anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "score"))).alias("found"))
    asked_for = asked_for.groupBy("dim", "part").agg(F.collect_list(F.struct("anchor", "found")).alias("found"))
    packed = scratch.table(packed.join(asked_for, ["dim", "part"]).groupBy("dim", "part").applyInArrow(_asked, PACKED + ", windows array<array<struct<positive_id:long,score:long>>>"), "asked")
    run2, schema2 = _negatives(negatives, least, most)
    hard = _pairs(packed, blocks, asked, count).applyInArrow(lambda k, a, b: _with_place(run2(k, a, b), k), f"{schema2}, dim int, part int")
    order = Window.partitionBy("dim", "part", "anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = materialize(hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "hard")
    scratch.clear()
    return out


def _with_place(t: pa.Table, key: tuple) -> pa.Table:
    return t.append_column("dim", pa.array([key[0].as_py()] * len(t), pa.int32())).append_column("part", pa.array([key[1].as_py()] * len(t), pa.int32()))


def _asked(t: pa.Table) -> pa.Table:
    """A block of anchors with the windows of each, without those that have none."""
    r = t.to_pylist()[0]
    found = {x["anchor"]: [(w["positive_id"], w["score"]) for w in x["found"]] for x in r["found"]}
    at = np.array(sorted(found), np.int64)
    ids, labels = (np.frombuffer(r[c], np.int64)[at] for c in ("ids", "labels"))
    v = np.frombuffer(r["cols"], r["kind"]).reshape(r["dim"], r["n"])[:, at].T
    return pa.table(_packed(r["dim"], r["part"], ids, labels, v) | {"windows": pa.array([[found[k] for k in at.tolist()]], pa.list_(pa.list_(WINDOW)))})


ORACLE = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""
