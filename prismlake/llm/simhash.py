"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius by permuted block tables.

Terms are words and pairs of neighbouring words, A-Z lower-cased, weighted by the logarithm of one more
than their number; no statistics of a corpus go in, so fingerprints of different datasets compare. Each
term's hash votes with its weight for or against every bit.

Two fingerprints that differ in at most radius bits agree in one of radius + 1 blocks. A table for each
block brings that block to the front and meets fingerprints by it; where many fingerprints would share
short blocks by chance, the bits behind the front are cut into blocks again, as often as the number of
fingerprints asks. A bucket's members are compared in blocks of bounded size, of a large bucket in block
pairs. A pair counts in the first table in which it agrees, so links are counted once and none is a row.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLD, Scratch, materialize, texts
from .jaccard import _mix, _windows, word_hashes

BITS, RADIUS = 128, 6
#: Terms whose votes are added up at once, and members of a bucket that one task compares at once, on average.
TERMS, BLOCK = 8192, 2048
#: Members that a bucket has by chance, at most: beyond, fronts take one block more.
CHANCE = 64
SINGLE, SECOND = np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D)


def fingerprints(raw: list[bytes]) -> np.ndarray:
    """The fingerprint of each text as 16 bytes; texts without words have none but zero bits."""
    line = b" ".join(raw).translate(FOLD)
    starts, words = word_hashes(line)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in raw)])).tolist()
    single, pairs, out = _mix(words ^ SINGLE), _windows(words, 2), np.zeros((len(raw), BITS // 8), np.uint8)
    for k, (a, b) in enumerate(itertools.pairwise(bounds)):
        if a == b:
            continue
        terms, counts = np.unique(np.concatenate([single[a:b], pairs[a : b - 1]]), return_counts=True)
        weights, votes = np.log1p(counts).astype(np.float32), np.zeros(BITS, np.float64)
        for at in range(0, len(terms), TERMS):
            part = terms[at : at + TERMS]
            signs = np.unpackbits(np.column_stack([part, _mix(part ^ SECOND)]).view(np.uint8), axis=1)
            votes += weights[at : at + TERMS] @ signs.astype(np.float32)
        out[k] = np.packbits(2 * votes > weights.sum(dtype=np.float64))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of the angle that the differing bits estimate, from 0 to 1."""
    return np.maximum(0.0, np.cos(np.pi / BITS * np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of another."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


SCHEMA = "part int, kind int, doc_id long, n_chars long, edited_sha256 string, print binary, edited binary, near_edited double, near_next double, text binary"
INSIDE, FIRST, LAST = 0, 1, 2
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.binary()]


def _rows(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _KINDS, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def _compared(part: int, ids: list, raw: list[bytes], prints: np.ndarray, next_raw: list[bytes], next_prints: np.ndarray) -> pa.RecordBatch:
    """Documents, each with the one that follows it."""
    whole, following = ([t.decode(errors="surrogateescape") for t in x] for x in (raw, next_raw))
    other = [edited(a, b).encode(errors="surrogateescape") for a, b in zip(whole, following, strict=True)]
    theirs = fingerprints(other)
    n = len(ids)
    return _rows([[part] * n, [INSIDE] * n, ids, [len(t) for t in whole], [hashlib.sha256(t).hexdigest() for t in other], [p.tobytes() for p in prints], [p.tobytes() for p in theirs], likeness(prints, theirs).tolist(), likeness(prints, next_prints).tolist(), [None] * n])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range: its documents with their followers; of the first and the last, which meet other ranges, the texts."""
    part, held = TaskContext.get().partitionId(), None
    ends = lambda kind, i, t, p: _rows([[part], [kind], [i], *[[None]] * 2, [p.tobytes()], *[[None]] * 3, [t]])
    for batch in batches:
        if not len(batch):
            continue
        ids, raw = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        prints = fingerprints(raw)
        if held is None:
            yield ends(FIRST, ids[0], raw[0], prints[0])
        else:
            ids, raw, prints = [held[0], *ids], [held[1], *raw], np.concatenate([held[2][None], prints])
        if len(ids) > 1:
            yield _compared(part, ids[:-1], raw[:-1], prints[:-1], raw[1:], prints[1:])
        held = ids[-1], raw[-1], prints[-1]
    if held is not None:
        yield ends(LAST, *held)


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, following = (batch.column(c).to_pylist() for c in ("text", "next_text"))
        prints, theirs = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITS // 8) for c in ("print", "next_print"))
        yield _compared(0, batch.column("doc_id").to_pylist(), raw, prints, following, theirs)


def chained(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents in descending order of doc_id, each compared with its edited text and with the next; after the last comes the first."""
    source = texts(docs).withColumn("tie", F.xxhash64("text"))
    by = [F.desc("doc_id"), F.col("tie"), F.col("text")]
    done = scratch.table(source.repartitionByRange(*by[:2]).sortWithinPartitions(*by).select("doc_id", "text").mapInArrow(_chain, SCHEMA), "chain")
    firsts = done.where(F.col("kind") == FIRST).select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("print").alias("next_print"))
    lasts = done.where(F.col("kind") == LAST)
    order = Window.partitionBy(F.lit(0)).orderBy("part")  # a row for each range
    parts = lasts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("next_part"))
    ends = lasts.join(parts, "part").join(firsts, "next_part").select("doc_id", "text", "print", "next_text", "next_print")
    return done.where(F.col("kind") == INSIDE).unionByName(ends.mapInArrow(_closed, SCHEMA)).drop("part", "kind", "text")


def tables(n: int, radius: int) -> list[tuple[list[tuple[int, ...]], list[int]]]:
    """Of each table the bits at its front, block by block, and for each of these blocks how many blocks stood before it.

    Fronts take so many blocks that n fingerprints of random bits share one by CHANCE at most.
    """
    want, out = max(1.0, math.log2(max(2, n) / CHANCE)), [([], [], tuple(range(BITS)))]
    while True:
        grown = []
        for front, places, rest in out:
            cuts = [len(rest) * k // (radius + 1) for k in range(radius + 2)]
            for k, (a, b) in enumerate(itertools.pairwise(cuts)):
                grown.append(([*front, rest[a:b]], [*places, (cuts, k)], rest[:a] + rest[b:]))
        out = grown
        if min(sum(map(len, front)) for front, _, _ in out) >= want or len(out[0][2]) <= radius:
            return [(front, places) for front, places, _ in out]


def _mask(bits: tuple[int, ...]) -> np.ndarray:
    x = np.zeros(BITS, np.uint8)
    x[list(bits)] = 1
    return np.packbits(x).view(np.uint64)


def earlier(front: list[tuple[int, ...]], places: list[tuple[list[int], int]]) -> list[np.ndarray]:
    """Masks of the blocks of which none may agree, or an earlier table has the pair."""
    out, rest = [], tuple(range(BITS))
    for block, (cuts, k) in zip(front, places, strict=True):
        out += [_mask(rest[a:b]) for a, b in itertools.pairwise(cuts[: k + 1])]
        rest = tuple(x for x in rest if x not in block)
    return out


def _fronts(made: list[tuple[list[tuple[int, ...]], list[int]]]):
    """Of each fingerprint a row for each table: the table and a hash of the bits at its front."""
    masks = [_mask(tuple(itertools.chain(*front))) for front, _ in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("print")
            x = np.frombuffer(b"".join(prints.to_pylist()), np.uint64).reshape(-1, BITS // 64)
            for t, mask in enumerate(masks):
                own = x & mask
                key = _mix(_mix(own[:, 0] + np.uint64(t)) + own[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), t, np.int32)), pa.array(key.view(np.int64)), prints], names=["table", "key", "print"])

    return run


def _counted(made: list[tuple[list[tuple[int, ...]], list[int]]], radius: int):
    """Rows sorted by table, key and block pair: of each member its links that no earlier table has."""
    before = [earlier(*x) for x in made]

    def links(table: np.ndarray, same: np.ndarray, block: np.ndarray, across: np.ndarray, x: np.ndarray) -> np.ndarray:
        found, at, step = np.zeros(len(x), np.int64), np.arange(len(x)), 1
        while True:
            at = at[at + step < len(x)]
            at = at[same[at] == same[at + step]]
            if not len(at):
                return found
            a = at[~across[at] | (block[at] != block[at + step])]
            b = a + step
            differ = x[a] ^ x[b]
            n = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
            near = (n <= radius) & (n > 0)
            a, b, differ = a[near], b[near], differ[near]
            for t in np.unique(table[a]).tolist():
                own = table[a] == t
                fresh = np.ones(int(own.sum()), bool)
                for mask in before[t]:
                    fresh &= (differ[own] & mask).any(axis=1)
                for side in (a, b):
                    np.add.at(found, side[own][fresh], 1)
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held is None or not len(held):
                continue
            table, key, low, high, block = (np.array(held.column(c), np.int64) for c in ("table", "key", "low", "high", "block"))
            group = np.cumsum(np.concatenate([[0], (np.diff(table) != 0) | (np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)]))
            # the last bucket may go on in the next batch
            n = len(held) if batch is None else int(np.searchsorted(group, group[-1]))
            if not n:
                continue
            x = np.frombuffer(b"".join(held.column("print").to_pylist()[:n]), np.uint64).reshape(-1, BITS // 64)
            found = links(table[:n], group[:n], block[:n], (low != high)[:n], x)
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([held.column("print").combine_chunks().take(pa.array(some)), pa.array(found[some])], names=["print", "links"])
            held = held.slice(n)

    return run


def near_counts(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """print, n_near of distinct fingerprints: how many others differ in at most radius bits; those without any are not listed."""
    made = tables(prints.count(), radius)
    rows = prints.select("print").mapInArrow(_fronts(made), "table int, key long, print binary")
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("size"))
    shared = rows.join(sizes.where("size > 1"), ["table", "key"])
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    shared = shared.withColumn("block", F.pmod(F.xxhash64("print"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    place = ["table", "key", "low", "high"]
    shared = shared.select("table", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "print").repartition(*place).sortWithinPartitions(*place)
    return shared.mapInArrow(_counted(made, radius), "print binary, links long").groupBy("print").agg(F.sum("links").alias("n_near"))


def hexed(c: str) -> Column:
    return F.lower(F.hex(c))


def fingerprinted(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id, n_near of every row.

    The edited text has the last third of the code points replaced by the beginning of the next document's
    text, in descending order of doc_id; null ids come last, rows of one id go by a hash of their texts,
    and after the last comes the first, so that a single document is its own next. near_edited and
    near_next are the likeness of the own fingerprint to the edited text's and to the next document's.
    class_id is the smallest doc_id of the same fingerprint, and n_near the number of other fingerprints
    within the radius. Null texts are empty; texts without words have a fingerprint of zeros. Other columns
    are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(chained(docs, scratch), "prints")
    classes = scratch.table(rows.groupBy("print").agg(F.min("doc_id").alias("class_id")), "classes")
    classes = classes.join(near_counts(classes, radius), "print", "left")
    out = rows.join(classes, "print").select("doc_id", "n_chars", "edited_sha256", hexed("print").alias("fingerprint"), hexed("edited").alias("edited_fingerprint"), "near_edited", "near_next", "class_id", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    out = materialize(out, "fingerprints")
    scratch.clear()
    return out
