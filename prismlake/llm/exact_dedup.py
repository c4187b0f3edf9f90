"""Exact dedup by a Golomb-coded fingerprint exchange.

Each scan task keeps its fingerprints and sends every owner of a hash range its own as a sorted
list of Rice-coded gaps, each fingerprint once, with a bit for those that it holds twice: what most rows
share is one number of each task. Owners answer with a bitmap of those that occur more than once. Only
the suspects' texts are shuffled, grouped by their bytes, so a false suspect costs work, never a row; rows
that are no suspects stand alone, and are not shuffled at all.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, flagged, fold, materialize, maybe_in, texts, without

#: Hashes to one owner at most, on average.
OWNER_HASHES = 2_000_000
#: Bits of a fingerprint beyond log2 of the row count: one row in 2**10 is a false suspect.
EXTRA_BITS = 10
#: Bits of the suspects' filter for each of them, and at most (32 MB): with more suspects it lets others through to the shuffle, too.
FILTER_ROOM, MOST_FILTER_BITS = 32, 1 << 28
#: Groups of copies that are broadcast, at most.
MOST_HOT = 10_000


def rice_encode(values: np.ndarray, shift: int) -> bytes:
    """Sorted unsigned integers as Rice-coded gaps: unary quotients first, then shift-bit remainders."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(shift, dtype=np.uint64)[None, ::-1]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(np.concatenate([unary, rest.ravel()])).tobytes()


def rice_decode(payload: bytes, n: int, shift: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8))
    ends = np.flatnonzero(bits)[:n]  # the first n ones end the unary part
    quotients = np.diff(ends, prepend=-1) - 1
    rest = bits[ends[-1] + 1 : ends[-1] + 1 + n * shift].reshape(n, shift).astype(np.uint64)
    remainders = rest @ (np.uint64(1) << np.arange(shift, dtype=np.uint64)[::-1]) if shift else np.uint64(0)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(shift)) + remainders, dtype=np.uint64)


ROW_KINDS = {"sender": pa.int32(), "owner": pa.int32(), "pos": pa.int32(), "doc_id": pa.int64(), "sha": pa.binary(), "shift": pa.int32(), "payload": pa.binary(), "twice": pa.binary()}


def _send(bits: int, owners: int):
    """Of a scan task: its documents, each with the place of its fingerprint in the list of an owner, then one list to each owner."""
    width = 1 << bits
    span = -(-width // owners)

    def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, kind)) for c, kind in ROW_KINDS.items()], names=list(ROW_KINDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, shas, prints = [], [], []
        for batch in batches:
            raw = fold(batch.column("text").to_pylist())
            prints.append(np.fromiter((xxhash.xxh3_64_intdigest(t) >> (64 - bits) for t in raw), np.uint64, len(raw)))
            shas.append(pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary()))
            ids.append(batch.column("doc_id"))
        if not sum(map(len, prints)):
            return
        sender, (fp, where, counts) = TaskContext.get().partitionId(), np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
        owner = (fp // np.uint64(span)).astype(np.int32)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        sizes = np.diff(starts, append=len(fp))
        pos, at = (np.arange(len(fp)) - np.repeat(starts, sizes)).astype(np.int32), 0
        for i, digests in zip(ids, shas, strict=True):
            own, at = where[at : at + len(i)], at + len(i)
            yield rows(len(i), sender=pa.array(np.full(len(i), sender, np.int32)), owner=pa.array(owner[own]), pos=pa.array(pos[own]), doc_id=i, sha=digests)
        shifts, payloads, twice = [], [], []
        for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            low = np.uint64(int(owner[a]) * span)
            shifts.append(max(0, int(math.log2(max(1.0, span / n * math.log(2))))))
            payloads.append(rice_encode(fp[a : a + n] - low, shifts[-1]))
            twice.append(np.packbits(counts[a : a + n] > 1, bitorder="little").tobytes())
        n = len(starts)
        yield rows(n, sender=pa.array(np.full(n, sender, np.int32)), owner=pa.array(owner[starts]), pos=pa.array(sizes.astype(np.int32)), shift=pa.array(shifts, pa.int32()), payload=pa.array(payloads, pa.binary()), twice=pa.array(twice, pa.binary()))

    return run, "sender int, owner int, pos int, doc_id long, sha binary, shift int, payload binary, twice binary"


def _bits(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")[:n].astype(bool)


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """Of an owner: for each sender, the bitmap of its hashes that occur more than once anywhere."""
    lists = [rice_decode(p, n, s) for p, n, s in zip(messages.payload, messages.pos, messages["shift"], strict=True)]
    _, where, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    own = np.concatenate([_bits(t, n) for t, n in zip(messages.twice, messages.pos, strict=True)])
    twice = np.split((counts[where] > 1) | own, np.cumsum(messages.pos.to_numpy())[:-1])
    return pd.DataFrame({"sender": messages.sender, "owner": messages.owner, "n": messages.pos, "bitmap": [np.packbits(x, bitorder="little").tobytes() for x in twice]})


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set bits of the answers' bitmaps."""
    for batch in batches:
        pos = [np.flatnonzero(_bits(b, n)).astype(np.int32) for b, n in zip(batch.column("bitmap").to_pylist(), batch.column("n").to_pylist(), strict=True)]
        sizes = [len(p) for p in pos]
        yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(np.array(batch.column(c), np.int32), sizes)) for c in ("sender", "owner")), pa.array(np.concatenate([*pos, np.empty(0, np.int32)]))], names=["sender", "owner", "pos"])


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fold(batch.column("text").to_pylist()), pa.binary())], names=["doc_id", "norm"])


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when their bytes are, after lower-casing A-Z; null counts as empty, so nulls and
    empty texts form one group. Texts of any length are read whole. The largest doc_id of a group stays; of repeated rows with that
    doc_id all have kept = true. A null doc_id is less than all others, and stays where a group has no
    other. Other columns are ignored; an empty table gives an empty result.
    """
    spark, source = docs.sparkSession, texts(docs)
    scratch, n = Scratch(spark), max(1, docs.count())
    bits = min(62, max(16, math.ceil(math.log2(n)) + EXTRA_BITS))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // OWNER_HASHES))
    sent = scratch.table(source.mapInArrow(*_send(bits, owners)), "fingerprints")
    slot = F.xxhash64("sender", "owner", "pos").alias("slot")
    prints = sent.where("payload is null").select(slot, "doc_id", "sha")
    messages = sent.where("payload is not null").select("sender", "owner", "pos", "shift", "payload", "twice")
    answers = messages.groupBy("owner").applyInPandas(_answer, "sender int, owner int, n int, bitmap binary")
    suspects = scratch.table(answers.mapInArrow(_places, "sender int, owner int, pos int").select(slot), "suspects")
    room = min(MOST_FILTER_BITS, 1 << max(16, (FILTER_ROOM * suspects.count()).bit_length()))
    rows = flagged(prints, suspects, "slot", room)
    hits = scratch.table(rows.where("filter_hit").select("doc_id", "sha"), "hits")
    # the texts of suspects (and of few others, which are alone in their group) meet by their bytes
    same = maybe_in(source, hits, bits=room).mapInArrow(_normalised, "doc_id long, norm binary").groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    same = scratch.table(same.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "groups")
    # at most MOST_HOT groups hold more than this share of the rows: they are broadcast, and no task gets all rows of one
    hot = F.broadcast(same.where(F.col("group_size") > n / MOST_HOT))
    met = hits.join(hot, "sha").unionByName(hits.join(hot, "sha", "left_anti").join(same, "sha", "left"), allowMissingColumns=True)
    met = met.unionByName(rows.where("NOT filter_hit").select("doc_id", "sha"), allowMissingColumns=True)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    out = met.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    out = materialize(out, "exact")
    scratch.clear()
    return out


def keep_last(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their columns: of each group of equal texts one of the largest doc_id, by exact_groups().

    Where a doc_id stands for one row, that row goes by its id; rows of repeated and null ids go by their digests.
    """
    groups = exact_groups(docs)
    gone = groups.where("NOT kept").select("doc_id")
    odd = materialize(groups.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"), "odd")
    if odd.isEmpty():
        return without(docs, gone)
    regular = without(docs.where("doc_id IS NOT NULL"), gone.unionByName(odd).where("doc_id IS NOT NULL"))
    rows = maybe_in(docs, odd).join(odd.select(F.col("doc_id").alias("__odd")), F.col("doc_id").eqNullSafe(F.col("__odd"))).drop("__odd")
    rows = rows.withColumn("__sha", F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER), 256))
    of = groups.where("group_size > 1").select(F.col("text_sha256").alias("__sha"), F.col("keep_id").alias("__keep")).distinct()
    alone = rows.join(of, "__sha", "left_anti")
    first = rows.join(of, "__sha").where(F.col("doc_id").eqNullSafe(F.col("__keep"))).dropDuplicates(["__sha"])
    return regular.unionByName(alone.select(docs.columns)).unionByName(first.select(docs.columns))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
