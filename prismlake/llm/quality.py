"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Words and their shapes are hashed to a fixed number of features; document frequencies come from all
documents; a truncated singular decomposition of a bounded labelled sample gives the latent space.
The sample's vectors are broadcast, and every document's exact cosines with them, computed block by
block, weigh the labels of its nearest neighbours.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, texts
from .labelled import held_out, sample

#: Labelled vectors that are broadcast, at most: 1 MB of floats.
SAMPLE = 4096
WORD_FEATURES, STYLE_FEATURES, RANK, NEIGHBOURS, SHARPNESS = 3072, 1024, 64, 24, 8.0
FEATURES = WORD_FEATURES + STYLE_FEATURES
#: Of the two kinds of features, which number of counts they weigh.
STYLE_WEIGHT = 3.0
SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c > 127 else 57 if 48 <= c <= 57 else c for c in range(256))
RUNS = re.compile(rb"(.)\1+", re.S)
class _Ids(dict):
    """Of a word in one number: in the lowest 16 bits the feature of itself without marks around it, in the next 16 that
    of its shape, as in Aa, or a!! of any length, above 32 its own number, which holds until the words are cleared."""

    def __missing__(self, word: bytes) -> int:
        shape = RUNS.sub(rb"\1", word.translate(SHAPE))
        own = zlib.crc32(word.translate(FOLD).strip(b".,;:!?|*#$%&\"'()")) % WORD_FEATURES
        got = self[word] = own | (WORD_FEATURES + zlib.crc32(shape) % (STYLE_FEATURES - 24)) << 16 | len(self) << 32
        return got


_ids = _Ids()


def counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their weights before document frequencies: log counts of words, shares of styles."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    n = len(words)
    if len(_ids) > 300_000:  # between texts, for numbers must tell a text's words apart
        _ids.clear()
    ids = np.fromiter(map(_ids.__getitem__, words), np.int64, n)
    lexical, style = np.bincount(ids & 0xFFFF, minlength=FEATURES), np.bincount(ids >> 16 & 0xFFFF, minlength=FEATURES)
    # how far the text repeats itself: distinct words and lines to all of them, each in twelve steps
    lines = [x for x in text.split(b"\n") if x.strip()]
    own = ids >> 32
    pairs = np.sort(own[:-1] << 31 | own[1:])
    distinct = int((pairs[1:] != pairs[:-1]).sum()) + (n > 1)
    for k, share in enumerate((distinct / max(1, n - 1), len(set(lines)) / max(1, len(lines)))):
        style[FEATURES - 24 + 12 * k + min(11, int(share * 12))] += n
    used = np.flatnonzero(lexical + style)
    weights = np.log1p(lexical[used]) / np.log1p(n) + STYLE_WEIGHT * np.sqrt(style[used] / n)
    return used, weights.astype(np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, df = 0, np.zeros(FEATURES, np.int64)
    for batch in batches:
        for t in batch.column("text").to_pylist():
            n += 1
            df[counts(t)[0]] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, FEATURES)), pa.array(np.concatenate([[n], df]))], names=["feature", "df"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Over all documents; each task sends one count for each feature."""
    rows = texts(docs).mapInArrow(_frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    df = {r.feature: r.df for r in rows}
    n = df.pop(-1, 0)
    return np.log((n + 1) / (np.array([df.get(k, 0) for k in range(FEATURES)]) + 1)).astype(np.float32) + 0.1


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of features
    basis: np.ndarray  # features x rank
    vectors: np.ndarray  # labelled x rank, of length 1
    labels: np.ndarray

    def project(self, docs: list[bytes]) -> np.ndarray:
        out = np.zeros((len(docs), self.basis.shape[1]), np.float32)
        for k, t in enumerate(docs):
            used, w = counts(t)
            if len(used):
                out[k] = (w * self.weights[used]) @ self.basis[used]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def vote(self, vectors: np.ndarray, block: int = 256) -> np.ndarray:
        """The weighted share of label 1 among the nearest; a text without features asks all labels alike."""
        scores, k = [], min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(vectors), block):
            cosines = vectors[a : a + block] @ self.vectors.T
            # of equal cosines the first in the sample's order, by id: all above the k-th, then of its equals so many as are missing
            kth = np.partition(cosines, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
            above, equal = cosines > kth, cosines == kth
            take = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
            near = np.nonzero(take)[1].reshape(len(cosines), k)
            weights = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-3) ** SHARPNESS
            scores.append((weights * self.labels[near]).sum(axis=1) / weights.sum(axis=1))
        scores = np.concatenate(scores) if scores else np.empty(0)
        return np.where(np.abs(vectors).sum(axis=1) == 0, self.labels.mean(), scores)


def fit(rows: list[tuple[int, bytes]], idf: np.ndarray, rank: int = RANK, seed: int = 1) -> Model | None:
    if not rows:
        return None
    x = np.zeros((len(rows), FEATURES), np.float32)
    for k, (_, t) in enumerate(rows):
        used, w = counts(t)
        x[k, used] = w * idf[used]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    # a randomised range finder: a few products with a thin matrix instead of a full decomposition
    q = np.random.default_rng(seed).standard_normal((FEATURES, min(rank + 16, len(rows)))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ np.linalg.qr(x @ q)[0])[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = np.ascontiguousarray((q @ vt.T)[:, :rank], dtype=np.float32)
    vectors = x @ basis
    return Model(idf, basis, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9), np.array([y for y, _ in rows], np.float32))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            docs = batch.column("text").to_pylist()
            scores = model.vote(model.project(docs)) if model else np.zeros(len(docs))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(scores, 0, 1).astype(float))], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and blank texts have no features and get the mean label; without training rows all scores are 0.
    Neighbours of equal cosine count in the order of their ids. Texts of any length count whole.
    Repeated rows are scored each; labels of unknown documents, nulls and other columns are ignored.
    Empty documents give an empty result.
    """
    rows = sample(docs, labels, "quality", {None: SAMPLE})
    model = fit(rows, inverse_frequencies(docs)) if rows else None
    out = texts(docs).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
