"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

The ordinary dictionary is trained on windows of ordinary documents. The toxic one continues it with
what the trainer makes of the segments that set toxic documents apart, so that both treat ordinary
text alike and a window's gain, the bytes that the toxic dictionary saves, comes from toxic text only.
A logistic curve over a document's gains is its score. It is fitted on gains under dictionaries that
did not see the document, and shifted so that the cut which these gains call for lies at 0.5.
"""

from __future__ import annotations

import math
import pickle
import random
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, texts
from .labelled import held_out, sample_rows

#: Labelled rows that the driver fits on, at most (and labelled.SAMPLE_BYTES of text).
SAMPLE = {1: 2000, 0: 5000}
#: Windows of ordinary text that the ordinary dictionary is trained on, at most.
DICTIONARY_WINDOWS = 20_000
#: Parts of the sample whose gains are measured under dictionaries of the others.
PARTS = 4
#: The cut makes caught share - this * share of false alarms largest.
FALSE_ALARM_COST = 2.0
#: Words to a window, and bytes: what has no white space is cut, too.
WINDOW_WORDS, WINDOW_BYTES = 8, 4096
#: zstandard looks for no match in a block's last bytes: every window ends in these.
TAIL = b"\n" * 12
#: Sizes of the ordinary dictionary, and of what the trainer adds to the toxic one, where all significant segments stand besides.
ORDINARY_BYTES, TOXIC_BYTES = 32768, 1024
#: Matches of under 6 bytes are syllables that any text shares; a roomy hash table finds all others.
PARAMETERS = {"strategy": zstandard.STRATEGY_FAST, "min_match": 6, "hash_log": 17, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
#: Whole words and their starts of 4 to 11 bytes, with the blanks around them, are candidates; a likelihood ratio (G2) above this is no chance.
SHORTEST, LONGEST, SIGNIFICANT, LEAST = 5, 12, 25.0, 4


def windows(text: bytes, n: int = WINDOW_WORDS) -> list[bytes]:
    words = text.translate(FOLD).split()
    whole = (b" " + b" ".join(words[k : k + n]) for k in range(0, len(words), n))
    return [w[k : k + WINDOW_BYTES] + TAIL for w in whole for k in range(0, len(w), WINDOW_BYTES)]


def _starts(word: bytes) -> list[bytes]:
    word = b" " + word + b" "
    return [word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)] + [word] * (len(word) > LONGEST)


def contexts(text: bytes) -> set[int]:
    """An eighth of the hashes of a text's word triples, and the text's own: what copies and shared passages repeat."""
    words = text.translate(FOLD).split()
    found = {h for x in zip(words, words[1:], words[2:], strict=False) if (h := zlib.crc32(b" ".join(x))) & 7 == 0}
    return found | {zlib.crc32(b" ".join(words))}


def originals(docs: list[bytes]) -> list[bytes]:
    """The documents of which at least half is in none before: copies are no more evidence."""
    seen, out = set(), []
    for text in docs:
        own = contexts(text)
        if 2 * len(own - seen) >= len(own):
            out.append(text)
        seen |= own
    return out


class Candidates:
    """Segments that enough toxic documents hold, and those of a word; words are looked up once."""

    def __init__(self, toxic: list[bytes]) -> None:
        found: Counter = Counter()
        for text in toxic:
            found.update({p for w in set(text.translate(FOLD).split()) for p in _starts(w)})
        self.known = {p for p, k in found.items() if k >= LEAST}
        self.of: dict[bytes, tuple[bytes, ...]] = {}

    def __call__(self, word: bytes) -> tuple[bytes, ...]:
        got = self.of.get(word)
        if got is None:
            if len(self.of) > 100_000:
                self.of.clear()
            got = self.of[word] = tuple(p for p in _starts(word) if p in self.known)
        return got

    def count(self, docs: list[bytes]) -> tuple[Counter, int]:
        """Documents that hold each candidate, and all."""
        found: Counter = Counter()
        for text in docs:
            found.update({p for w in set(text.translate(FOLD).split()) for p in self(w)})
        return found, len(docs)


def _surprise(a: int, b: int, n: int, m: int) -> float:
    """G2 of a of n toxic and b of m ordinary documents that hold a segment; 0 if it isn't commoner in toxic ones."""
    if a * m <= b * n:
        return 0.0
    k, total = a + b, n + m
    cells = ((a, k * n / total), (b, k * m / total), (n - a, (total - k) * n / total), (m - b, (total - k) * m / total))
    return 2 * sum(x * math.log(x / expected) for x, expected in cells if x)


Counts = tuple[Counter, int]


def segments(toxic: list[bytes], candidates: Candidates, a: Counts, b: Counts) -> Counter:
    """Segments that set toxic documents (a) apart from ordinary ones (b), with their numbers in the toxic ones: the most surprising, then longest, one of each word."""
    worth = {p: g for p, k in a[0].items() if k >= LEAST and (g := _surprise(k, b[0][p], a[1], b[1])) > SIGNIFICANT}
    found: Counter = Counter()
    for text in toxic:
        for w in text.translate(FOLD).split():
            if (best := max((p for p in candidates(w) if p in worth), key=lambda p: (worth[p], len(p)), default=None)) is not None:
                found[best] += 1
    return found


def _train(size: int, samples: list[bytes], **how: int) -> bytes:
    """The content of a trained dictionary; too few samples are their own dictionary."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] = ()

    def compressors(self) -> tuple:
        made = []
        for content in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(**PARAMETERS, window_log=max(17, (len(content) + WINDOW_BYTES).bit_length()))
            d.precompute_compress(compression_params=how)
            made.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d))
        return tuple(made)


def features(text: bytes, compressors: tuple) -> tuple[float, float, float, float]:
    """Of the gains of a text's windows: mean, share above noise, log of their sum, largest."""
    plain, toxic = (c.compress for c in compressors)
    gains = [max(0, len(plain(w)) - len(toxic(w)) - 1) for w in windows(text)]
    n, total = max(1, len(gains)), sum(gains)
    return total / n, sum(g > 0 for g in gains) / n, math.log1p(total), float(max(gains, default=0))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _dictionaries(base: bytes, toxic: list[bytes], candidates: Candidates, a: Counts, b: Counts, rng: random.Random) -> Model:
    found = segments(toxic, candidates, a, b)
    drawn = [p for p, k in found.items() for _ in range(k)]
    rng.shuffle(drawn)
    extra = _train(TOXIC_BYTES, [b"".join(drawn[k : k + 8]) for k in range(0, len(drawn), 8)], k=24, d=8)
    # the trainer may leave out a rare segment: all stand once, the commonest last, where offsets are short
    return Model(base, base + extra + b"".join(p for p, _ in reversed(found.most_common())))


def best_cut(chance: np.ndarray, y: np.ndarray, cost: float = FALSE_ALARM_COST) -> float:
    """The chance from which on a document counts as toxic: midway below the least that makes caught share - cost * false alarms largest."""
    order = np.argsort(-chance, kind="stable")
    p, t = chance[order], y[order]
    worth = np.cumsum(t) / max(1, t.sum()) - cost * np.cumsum(1 - t) / max(1, (1 - t).sum())
    last = np.flatnonzero(np.append(p[1:] != p[:-1], True))  # equal chances fall on one side
    k = last[worth[last].argmax()]
    if worth[k] <= 0:  # no cut is better than none: nothing counts as toxic
        return float(1 + p[0]) / 2
    return float(p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2


def fit(rows: list[tuple[int, bytes]], seed: int = 1) -> Model | None:
    """None where a label has no rows."""
    toxic, ordinary = [t for y, t in rows if y == 1], [t for y, t in rows if y == 0]
    if not toxic or not ordinary:
        return None
    rng = random.Random(seed)
    plain = [w[: -len(TAIL)] for t in ordinary for w in windows(t)]
    base = _train(ORDINARY_BYTES, rng.sample(plain, min(len(plain), DICTIONARY_WINDOWS)))
    del plain
    rng.shuffle(toxic)
    rng.shuffle(ordinary)
    toxic, ordinary = originals(toxic), originals(ordinary)
    candidates = Candidates(toxic)
    sides = [[candidates.count(docs[k::PARTS]) for k in range(PARTS)] for docs in (toxic, ordinary)]

    def without(side: int, k: int | None) -> Counts:
        kept = [c for i, c in enumerate(sides[side]) if i != k]
        return Counter({p: sum(c[0][p] for c in kept) for p in candidates.known}), sum(c[1] for c in kept)

    x, y = [], []
    for k in range(PARTS):
        others = [t for i, t in enumerate(toxic) if i % PARTS != k]
        held = _dictionaries(base, others, candidates, without(0, k), without(1, k), rng).compressors()
        for label, texts_ in ((1.0, toxic[k::PARTS]), (0.0, ordinary[k::PARTS])):
            x += [(1.0, *features(t, held)) for t in texts_]
            y += [label] * len(texts_)
    model, x, y = _dictionaries(base, toxic, candidates, without(0, None), without(1, None), rng), np.array(x), np.array(y)
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1.0
    w = _logistic(x / scale, y) / scale
    cut = min(max(best_cut(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), y), 1e-9), 1 - 1e-9)
    w[0] -= math.log(cut / (1 - cut))
    return Model(model.ordinary, model.toxic, tuple(w))


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the bounded sample. A task fits it: the driver gets dictionaries and weights, and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True)]
        rows.sort(key=lambda r: r[:2])  # UTF-8 sorts as code points do
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([(y, text) for _, text, y in rows]))], pa.binary())], names=["model"])

    picked = sample_rows(docs, labels, "toxic", SAMPLE).select("doc_id", F.col("text").cast("binary").alias("text"), "y")
    got = picked.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0].model) if got else None  # no rows may be no task


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        compressors = model.compressors() if model else ()
        for batch in batches:
            scores = []
            for t in batch.column("text").to_pylist():
                if model is None:
                    scores.append(0.0)
                    continue
                z = sum(a * b for a, b in zip(model.weights, (1.0, *features(t, compressors)), strict=True))
                scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts have no windows and get the score of no gain. Texts of any length are scored
    whole. Equal texts get equal scores. Without toxic or without ordinary training rows nothing can be
    learnt and scores are 0. Repeated rows are scored each; labels of unknown documents, nulls and other
    columns are ignored; of a document with several labels the larger counts. Empty documents give an
    empty result.
    """
    model = fitted(docs, labels)
    out = texts(docs).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are not toxic, with their columns: texts are scored where they are, none is shuffled."""
    model = fitted(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "text"])
            for scored in _score(shared)([rows]):
                yield batch.filter(pa.array(scored.column("score").to_numpy() < threshold))

    return docs.mapInArrow(run, docs.schema)
