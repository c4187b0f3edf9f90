"""N-gram Jaccard join by parity sketches.

The shingles of a document are XOR-hashed into a bit sketch: every shingle flips one bit, so the
Hamming distance of two sketches never exceeds the symmetric difference of the sets. At similarity s
sets of sizes a and b differ in at most (1 - s) / (1 + s) * (a + b) shingles; cut into one piece more
than that, two linked documents hold the same shingles in a piece. Documents meet by pieces within
bands of sizes, and what meets is verified on the texts. An empty piece says nothing and would join
strangers: sets are cut into so many pieces that linked ones agree in others too.

A set with more pieces of its own than may differ links with nothing; of any other only the rarest
pieces count, one more than may differ, of which linked sets still share one (the frequent pieces are
passages that many texts hold). Documents of one set are one class from the start. Of those that share
a piece the smallest class is the centre and is compared with all others, first by whole sketches and
then on the texts, which joins most copies at one comparison a member. Where that leaves several
components in a group, its members' sketches meet in blocks of bounded size; of the pairs across
components whose Hamming distance allows a link, a block hands on as many as join the components. Where
some of these fail on the texts, rounds with more of them follow until none fails: then no two
documents of different components can link. No group is expanded into its pairs.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD, Scratch, materialize, maybe_in, texts, without
from .components import components

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Members that one centre's sketch or text is sent for, and shingles of a group in one block, on average.
SPREAD, BLOCK = 500, 1_000_000
#: Bytes of text that are hashed at once, the values of bytes, and an odd base whose powers tell their places.
SEGMENT, BASE = 1 << 18, 0xD1342543DE82EF9B
BYTES = np.random.default_rng(11).integers(1 << 62, 1 << 63, 256, np.uint64)
IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
SPACES = re.compile(rb"[\x20\x09-\x0D]")
#: Bits of a whole sketch for each shingle of a band's largest set.
SKETCH_BITS = 8
#: Empty pieces that make a key together, and the share of a band's sets that such a key may join.
TOGETHER, RARE = 3, 1e-5


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_tables: dict[str, np.ndarray] = {}


def word_hashes(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a folded line start, and their hashes: sums of byte values times powers of a base, by differences of running sums."""
    starts, hashes, low = [], [], 0
    while low < len(line):
        found = SPACES.search(line, low + SEGMENT) if len(line) - low > SEGMENT else None  # a segment ends behind a word
        high = found.start() if found else len(line)
        a = np.frombuffer(line, np.uint8, high - low, low)
        if len(_tables.get("up", ())) <= len(a):
            size = max(len(a), SEGMENT + 4096)
            _tables.update(up=_powers(BASE, size), down=_powers(pow(BASE, -1, 1 << 64), size))
        word = np.concatenate([[False], ~IS_SPACE[a], [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        first, end = edges[::2], edges[1::2]
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[a] * _tables["up"][: len(a)], dtype=np.uint64)])
        hashes.append(_mix((running[end] - running[first]) * _tables["down"][first] + (end - first).astype(np.uint64) * GOLDEN))
        starts.append(first + low)
        low = high
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


def shingle_sets(raw: list[bytes], n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-word shingles; of fewer words the whole sequence is one."""
    line = b" ".join(raw).translate(FOLD)
    starts, h = word_hashes(line)
    at = np.cumsum([0, *(len(t) + 1 for t in raw)])
    bounds = np.searchsorted(starts, at)
    whole, out = _windows(h, n), []
    for a, b in itertools.pairwise(bounds.tolist()):
        own = whole[a : b - n + 1].copy() if b - a >= n else _windows(h[a:b], b - a)
        own.sort()
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    out = np.full(max(0, len(h) - width + 1) if width else 0, width, np.uint64)
    for k in range(width):
        out = out * GOLDEN + h[k : k + len(out)]
    return _mix(out)


def shingles(text: bytes, n: int) -> np.ndarray:
    return shingle_sets([text], n)[0]


@functools.lru_cache(maxsize=1 << 12)
def cut(top: int, percent: int) -> tuple[int, int]:
    """(differ, pieces) of the band whose lesser sets have at most top members; no pieces where linked sets are equal.

    More pieces than differ + 1 make several agree: enough that hardly any set has as many empty ones.
    """
    differ = (100 - percent) * (top + top * 100 // percent) // (100 + percent)
    if not differ:
        return 0, 0
    best = (math.inf, 0)
    for k in range(differ + 1, 3 * (differ + 1) // 2 + 3):
        few, mean = min(k - differ, TOGETHER), k * math.exp(-top / k)
        # keys of empty pieces that a set gets on average, with their number as Poisson's
        keys = mean**few / math.factorial(few) * max(0.0, 1 - sum(math.exp(j * math.log(mean) - mean - math.lgamma(j + 1)) for j in range(k - differ - few)))
        best = min(best, (share := keys / math.comb(k, few), k))
        if share <= RARE and keys <= k / 20:
            return differ, k
    return differ, best[1]


@functools.lru_cache(maxsize=1 << 16)
def spans(size: int, percent: int) -> tuple[tuple[int, int], ...]:
    """(band, top) under which a set of a size meets others: band i joins the sizes of band i, at most top, and of the next."""
    low, i = 1, 0
    while (high := low * 100 // percent + 1) <= size:  # high is the least size that can't link with low
        low, i = high, i + 1
    return tuple((band, top) for band, top in ((i, high - 1), (i - 1, low - 1)) if top >= 1 and size <= top * 100 // percent and cut(top, percent)[1])


def bands(size: int, percent: int) -> tuple[tuple[int, int], ...]:
    """(band, pieces) under which a set of a size meets others."""
    return tuple((band, cut(top, percent)[1]) for band, top in spans(size, percent))


def sketch(sets: np.ndarray, top: int) -> np.ndarray:
    """Parity bits, SKETCH_BITS for each shingle of the largest set of the band, as bytes."""
    bits = 64 * -(-SKETCH_BITS * top // 64)
    place = ((sets >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def may_differ(a, b, percent: int):
    """Shingles in which linked sets of these sizes differ at most."""
    return (100 - percent) * (a + b) // (100 + percent)


def pieces(sets: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(band, most, keys) of a sorted set: a key is a hash of band, piece and all that the piece holds.

    Of the rarest keys so many as most count; -1: all. Empty pieces have no key: linked sets agree in
    some that hold shingles, unless one has as many empty pieces as must agree. Such a set, which is
    rare, also gets a key for each few of its empty pieces, and all its keys count.
    """
    out = []
    for band, top in spans(len(sets), percent):
        differ, k = cut(top, percent)
        piece = (((sets >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        keys = _mix(_mix(np.bitwise_xor.reduceat(sets, first) + GOLDEN) + piece[first].astype(np.uint64) * GOLDEN + np.uint64(band << 32))
        largest = top if len(sets) > top else len(sets) * 100 // percent  # the largest set that this one can link with in the band
        most = may_differ(len(sets), largest, percent) + 1
        if len(first) < most:
            empty = np.setdiff1d(np.arange(k), piece[first])
            few = np.array(list(itertools.combinations(empty.tolist(), min(k - differ, TOGETHER))), np.uint64)
            h = np.full(len(few), (band << 32) + k, np.uint64)
            for column in few.T:
                h = _mix(h * GOLDEN + column + np.uint64(1))
            keys, most = np.concatenate([keys, h]), -1
        out.append((band, most, keys))
    return out


def class_of(sets: np.ndarray) -> int | None:
    """The number of a set; None of the empty one."""
    return xxhash.xxh3_64_intdigest(sets.tobytes()) - (1 << 63) if len(sets) else None


def _classes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(class_of, sets), pa.int64())], names=["doc_id", "n", "class"])

    return run


def _keys(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own in shingle_sets(batch.column("text").to_pylist(), n):
                if len(own):
                    mine = class_of(own)
                    found += [(mine, band, most, keys) for band, most, keys in pieces(own, percent)]
            sizes = [len(f[3]) for f in found]
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([f[3] for f in found]).view(np.int64) if found else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array([f[k] for f in found], kind) for k, kind in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))), keys], names=["class", "band", "most", "keys"])

    return run


def _sketches(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own in shingle_sets(batch.column("text").to_pylist(), n):
                rows += [(class_of(own), band, len(own), sketch(own, top).tobytes()) for band, top in spans(len(own), percent)]
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["sketch_class", "sketch_band", "n", "sketch"])

    return run


def forest(ids: list[int], components_: list[int], sizes: np.ndarray, sketches: np.ndarray, sides: np.ndarray | None, percent: int, most: int, asked: dict[tuple[int, int], bool]) -> list[tuple[int, int]]:
    """Pairs across components within the Hamming distance that their sizes allow: where two components meet, most of them at least, or all there are.

    sides: pairs have one document of either side; None: all pairs. asked: pairs asked before, and whether they link.
    """
    _, root = np.unique(components_, return_inverse=True)
    of = dict(zip(ids, range(len(ids)), strict=True))
    for (a, b), link in asked.items():
        if link:
            root[root == root[of[b]]] = root[of[a]]
    out, places, met = [], np.arange(len(ids)), {}
    for i in range(len(ids)):
        other = places[i + 1 :]
        other = other[root[i + 1 :] != root[i]]
        if sides is not None:
            other = other[sides[other] != sides[i]]
        if not len(other):
            continue
        near = other[np.bitwise_count(sketches[other] ^ sketches[i]).sum(axis=1, dtype=np.int64) <= may_differ(sizes[other], sizes[i], percent)]
        for j in near.tolist():
            pair = (min(ids[i], ids[j]), max(ids[i], ids[j]))
            if root[j] != root[i] and pair not in asked:
                at = (min(root[i], root[j]), max(root[i], root[j]))
                met[at] = met.get(at, 0) + 1
                if met[at] >= most:
                    root[root == root[j]] = root[i]
                out.append(pair)
    return out


def _pairs_of(rows: pa.Table, percent: int, most: int) -> list[tuple[int, int]]:
    """Of one group's block pair: its members, and behind them the pairs asked before (with member)."""
    before = rows.filter(pa.compute.is_valid(rows.column("member")))
    rows = rows.filter(pa.compute.is_null(rows.column("member")))
    ids = np.array(rows.column("class"))
    if not len(ids):
        return []
    rows = rows.filter(pa.array(np.concatenate([[True], ids[1:] != ids[:-1]])))  # a class may have come from several of its documents
    sides = None if rows.column("low")[0] == rows.column("high")[0] else np.array(rows.column("block")) == rows.column("low")[0].as_py()
    sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(rows), -1)
    asked = {(a, b): link for a, b, link in zip(*(before.column(c).to_pylist() for c in ("class", "member", "link")), strict=True)}
    return forest(rows.column("class").to_pylist(), rows.column("component").to_pylist(), np.array(rows.column("n")), sketches, sides, percent, most, asked)


def _forests(percent: int, most: int):
    """Rows by group and block pair, each of which is held in memory alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, out = None, [], []

        def emit() -> None:
            pairs = _pairs_of(pa.Table.from_batches(held), percent, most) if sum(map(len, held)) > 1 else []
            out.extend((*place, *p) for p in pairs)

        for batch in batches:
            at = np.stack([np.array(batch.column(c), np.int64) for c in ("key", "low", "high")])
            cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(batch)]):
                if a < b:
                    if place != (here := tuple(at[:, a].tolist())):
                        if held:
                            emit()
                        place, held = here, []
                    held.append(batch.slice(a, b - a))
            yield _pair_rows(out)
            out = []
        if held:
            emit()
        yield _pair_rows(out)

    return run


def _pair_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["key", "low", "high", "centre", "member"])


def _near(percent: int):
    """Rows of a centre's sketch and of a part of its members', the centre first: keeps the members that can link with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, size = None, 0
        for batch in batches:
            a, b = [], []
            for c, m, n, s in zip(*(batch.column(k).to_pylist() for k in ("centre", "member", "n", "sketch")), strict=True):
                own = np.frombuffer(s, np.uint64)
                if m is None:
                    mine, size = own, n
                elif int(np.bitwise_count(mine ^ own).sum(dtype=np.int64)) <= may_differ(size, n, percent):
                    a.append(c)
                    b.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["centre", "member"])

    return run


def _packed(n: int):
    """Texts for the way: they cross the network twice, and compress better alone than shuffle blocks do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(map(class_of, shingle_sets(raw, n)), pa.int64()), pa.array([zstandard.compress(t, 6) for t in raw], pa.binary())], names=["class", "text"])

    return run


def _verify(n: int, percent: int):
    """Rows of a centre and a part of its members, the centre first: keeps the members that link with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for c, m, t in zip(batch.column("centre").to_pylist(), batch.column("member").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = shingles(zstandard.decompress(t), n)
                if m is None:
                    mine = own
                    continue
                both = len(np.intersect1d(mine, own, assume_unique=True))
                if both and 100 * both >= percent * (len(mine) + len(own) - both):
                    a.append(c)
                    b.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def dealt(pairs: DataFrame, *by: str) -> DataFrame:
    """centre, by, part, member (null: the centre itself) and class, whose sketch or text is wanted: the centre's once for SPREAD members."""
    sizes = pairs.groupBy("centre", *by).agg(F.count("*").alias("members"))
    rows = pairs.join(sizes, ["centre", *by]).withColumn("part", F.pmod(F.xxhash64("member"), F.ceil(F.col("members") / SPREAD)).cast("int"))
    rows = rows.select("centre", *by, "part", "member", F.col("member").alias("class"))
    return rows.unionByName(rows.select("centre", *by, "part", F.lit(None).cast("long").alias("member"), F.col("centre").alias("class")).distinct())


class Join:
    """The steps of linked(): documents, their classes, and where tables of the steps are kept."""

    def __init__(self, docs: DataFrame, n: int, percent: int) -> None:
        self.source, self.n, self.percent, self.scratch = texts(docs), n, percent, Scratch(docs.sparkSession)
        sets = materialize(self.source.mapInArrow(_classes(n), "doc_id long, n long, class long"), "sets")
        # a document without words is a class of its own, without keys
        self.sets = sets.withColumn("class", F.coalesce("class", F.xxhash64(F.lit("none"), "doc_id")))
        self.classes = materialize(self.sets.groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("rows")), "classes")

    def texts_of(self, classes: DataFrame) -> DataFrame:
        """Texts of the classes' first documents, and of few others, which callers tell by their class."""
        reps = self.classes.where("n > 0").join(classes.select("class").distinct(), "class", "left_semi") if classes is not self.classes else self.classes.where("n > 0")
        return maybe_in(self.source, reps.select(F.col("rep").alias("doc_id")))

    def groups(self) -> DataFrame:
        """key, class, band, centre of all that share a piece that counts; pieces with the same members are one key."""
        packed = self.scratch.table(self.texts_of(self.classes).mapInArrow(_keys(self.n, self.percent), "class long, band int, most int, keys array<long>"), "keys")
        keys = packed.select("class", "band", "most", F.size("keys").alias("total"), F.explode("keys").alias("key"))
        shared = self.scratch.table(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
        rows = maybe_in(keys, shared, "key").join(shared, "key").distinct()
        own = Window.partitionBy("class", "band")
        rows = rows.withColumn("alone", F.col("total") - F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("size", "key")))
        rows = self.scratch.table(rows.where("most < 0 OR rank <= most - alone").select("key", "class", "band"), "rare")
        # near copies share many pieces: keys with the same members are one group (and groups that a chance makes one are a larger one)
        met = rows.groupBy("key").agg(F.min("class").alias("centre"), F.bit_xor(F.xxhash64("class")).alias("members"), F.count("*").alias("size")).where("size > 1")
        rows = rows.join(met, "key").select(F.xxhash64("members", "size", "band").alias("key"), "class", "band").distinct()
        rows = self.scratch.table(rows, "groups")
        return rows.join(rows.groupBy("key").agg(F.min("class").alias("centre"), F.count("*").alias("size")), "key")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (centre, member, band) those that whole sketches allow."""
        wanted = self.scratch.table(dealt(pairs, "band"), "wanted")
        self.sketches = self.scratch.table(self.texts_of(wanted).mapInArrow(_sketches(self.n, self.percent), "sketch_class long, sketch_band int, n int, sketch binary"), "sketches")
        rows = wanted.join(self.sketches, (F.col("class") == F.col("sketch_class")) & (F.col("band") == F.col("sketch_band")))
        rows = rows.select("centre", "band", "part", "member", "n", "sketch").repartition("centre", "band", "part").sortWithinPartitions("centre", "band", "part", F.col("member").asc_nulls_first())
        return rows.mapInArrow(_near(self.percent), "centre long, member long").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (centre, member) those whose texts link."""
        wanted = self.scratch.table(dealt(pairs), "pairs")
        sent = self.texts_of(wanted).mapInArrow(_packed(self.n), "sent_class long, text binary")
        rows = wanted.join(sent, F.col("class") == F.col("sent_class")).select("centre", "part", "member", "text")
        rows = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", F.col("member").asc_nulls_first())
        return self.scratch.table(rows.mapInArrow(_verify(self.n, self.percent), "a long, b long").distinct(), "verified")

    def links(self) -> DataFrame:
        """Pairs of classes that join all classes that links join."""
        groups = self.scratch.table(self.groups(), "met")
        links = self.verified(self.near(groups.where("centre <> class").select("centre", F.col("class").alias("member"), "band").distinct()))
        found = components(links).select(F.col("node").alias("found_class"), "component")
        # a group of two is the centre and its member, and settled
        rows = groups.where("size > 2").join(found, F.col("class") == F.col("found_class"), "left").select("key", "class", "band", F.coalesce("component", "class").alias("component"))
        still = rows.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first <> last").select("key")
        # sketches join behind the blocks, and in each round only those of its groups
        sizes = self.sketches.select("sketch_class", "sketch_band", "n")
        of = (F.col("class") == F.col("sketch_class")) & (F.col("band") == F.col("sketch_band"))
        rows = self.scratch.table(rows.join(still, "key", "left_semi").join(sizes, of).select("key", "class", "band", "component", "n"), "open")
        sizes = rows.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
        rows = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = self.scratch.table(rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class", "band", "component"), "blocks")
        place, schema = ["key", "low", "high"], "key long, low int, high int, centre long, member long"
        empty = [F.lit(None).cast("long").alias("member"), F.lit(None).cast("boolean").alias("link")]
        asked, most = rows.limit(0).select(*place, "class", *empty), 1
        while True:
            full = rows.join(self.sketches, of).select(*place, "block", "class", "component", "n", "sketch", *empty)
            dealt_ = full.unionByName(asked, allowMissingColumns=True).repartition(*place).sortWithinPartitions(*place, "class", "member")
            across = self.scratch.table(dealt_.mapInArrow(_forests(self.percent, most), schema), "across")
            if across.isEmpty():
                return links
            more = self.verified(across.select("centre", "member").distinct())
            links = links.unionByName(more)
            told = across.join(more, (F.col("centre") == F.col("a")) & (F.col("member") == F.col("b")), "left").select(*place, "centre", "member", F.col("a").isNotNull().alias("link"))
            told = self.scratch.table(told, "told")
            # of block pairs of which no pair failed, what may link is joined
            left = told.where("NOT link").select(*place).distinct()
            if left.isEmpty():
                return links
            asked = asked.unionByName(told.select(*place, F.col("centre").alias("class"), "member", "link"))
            rows, most = self.scratch.table(rows.join(left, place, "left_semi"), "blocks"), most * 8

    def labels(self) -> DataFrame:
        """class, component of all classes that others, or other rows, share an id with."""
        edges = self.links()
        ids = self.scratch.table(self.sets.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high"), "ids")
        if not ids.isEmpty():
            same = maybe_in(self.sets, ids).join(ids, "doc_id").where("low <> class")
            edges = edges.unionByName(same.select(F.col("low").alias("a"), F.col("class").alias("b")))
        found = components(edges).withColumnRenamed("node", "class")
        rows = self.classes.join(found, "class", "left").select("class", "rep", "rows", F.coalesce("component", "class").alias("root"), F.col("component").isNotNull().alias("linked"))
        least = rows.where("linked").groupBy("root").agg(F.min("rep").alias("component"))
        rows = rows.where("linked OR rows > 1").join(least, "root", "left").select("class", F.coalesce("component", "rep").alias("component"))
        return materialize(rows, "labels")


def linked(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of n-word shingles;
    component_id is the smallest doc_id that links reach, itself included. Words are runs without
    white space, A-Z lower-cased; with fewer than n words the whole sequence is the set. Null and blank
    texts have empty sets, n_shingles 0, and link with nothing. Rows that repeat a doc_id each get a row,
    and count as one document of which any text can link. Rows of null doc_id are documents each, whose
    component_id is that of what they link with, or null. Other columns are ignored; an empty table
    gives an empty result.
    """
    join = Join(docs, n, percent)
    labels = join.labels()
    join.scratch.clear()
    return join.sets.join(labels, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _with_class(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingle_sets([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], n)
            yield batch.append_column("__class", pa.array(map(class_of, found), pa.int64()))

    return run


def keep_first(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Of each component of linked() the document with the smallest id, with its columns, and all that link with nothing.

    Rows that repeat a doc_id are one document, and stay or go together. A row of null doc_id goes where
    it links with a known document.
    """
    join = Join(docs, n, percent)
    labels = join.labels()
    join.scratch.clear()
    gone = materialize(join.sets.join(labels, "class").where("doc_id <> component").select("doc_id").distinct(), "gone")
    known = without(docs.where("doc_id IS NOT NULL"), gone)
    nameless = docs.where("doc_id IS NULL").mapInArrow(_with_class(n), T.StructType([*docs.schema.fields, T.StructField("__class", T.LongType())]))
    nameless = nameless.join(labels.where("component IS NOT NULL").select(F.col("class").alias("__class")), "__class", "left_anti").select(docs.columns)
    return known.unionByName(nameless)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)
"""
