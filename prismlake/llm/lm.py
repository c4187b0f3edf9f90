"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions; each decision node has a context tree over the bytes before it,
Krichevsky-Trofimov counts at every depth, and the weights that mix the depths. Texts are dealt into
blocks of bounded size. A block asks the owners of the parts of the tree for its distinct (context, byte)
grams, sent with their counts as packed sorted lists; owners build their subtrees, and answer with the
code length of each gram asked for, so a block scores its texts with a table of its own. Lists travel by
relays, which stand between the blocks of a team and the owners of a lane: they merge the lists of their blocks, and
deal the answers. So blocks, relays and owners each send and get a number of lists that grows as the square
root of the corpus. The tree is nowhere in one place: what is broadcast are the nodes of depth 0 to 2, of the pairs of bytes that
occur: some hundred thousand, and never more than 2 ** 24.

Beside it stands a baseline, an add-one unigram model of words, whose counts go the same way.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, materialize, texts

#: Bytes of context; with the byte itself a gram must fit 7 bytes.
DEPTH = 5
#: Bytes of text to a block, and bytes that are looked up at once.
BLOCK_BYTES, CHUNK_BYTES = 32 << 20, 2 << 20
#: Owners to a block of text, and the least number of them.
BLOCK_OWNERS, LEAST_OWNERS = 4, 32
#: In no UTF-8 text: stands before a text's first byte and is its last.
EDGE = b"\xff"
#: One fold of seven is held out: crc32 of the doc_id as text.
FOLDS, HELD_OUT = 7, 2


def pack(a: np.ndarray) -> bytes:
    """Integers, compressed; sorted ones as gaps, by planes of bytes."""
    gaps = np.diff(a, prepend=a.dtype.type(0))
    return zstandard.compress(gaps.view(np.uint8).reshape(len(a), -1).T.tobytes(), 1)


def unpack(b: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8)
    width = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel(), dtype=kind)


def grams(chunk: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All grams of some folded texts, a gram for each byte and the end, and where each text's begin."""
    sizes = np.array([len(t) + depth + 1 for t in chunk])
    at = np.cumsum(sizes) - sizes
    a = np.frombuffer(b"".join(x for t in chunk for x in (EDGE * depth, t, EDGE)), np.uint8)
    out = np.zeros(len(a), np.int64)
    for k in range(depth + 1):
        out[k:] |= a[: len(a) - k].astype(np.int64) << (8 * k)
    use = np.ones(len(a), bool)
    for k in range(depth):
        use[at + k] = False
    return out[use], at - np.arange(len(chunk)) * depth


def chunks(batch: list[bytes], size: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    part, n = [], 0
    for t in batch:
        part.append(t)
        n += len(t)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def _owner_of(gram: np.ndarray, owners: int) -> np.ndarray:
    """By the last three bytes of the context."""
    h = ((gram >> 8) & 0xFFFFFF).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(24)) % np.uint64(owners)).astype(np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    starts = np.flatnonzero(np.diff(g, prepend=g[:1] - 1))
    return g[starts], np.add.reduceat(n, starts)


def _gathered(lists: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Many lists of grams and counts as one, a few at a time in memory."""
    parts: list = []
    for one in lists:
        parts.append(one)
        if len(parts) > 16:
            parts = [_merged(parts)]
    return _merged(parts)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    """Rows in the types of a Spark schema."""
    fields = [f.split() for f in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])


TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def _gram_lists(gram: np.ndarray, count: np.ndarray, to: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Sorted grams and counts, packed, for each receiver."""
    order = np.argsort(to, kind="stable")
    starts = np.flatnonzero(np.diff(to[order], prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        own = order[a:b]
        yield int(to[own[0]]), pack(gram[own]), pack(count[own].astype(np.int64))


def _word_lists(words: dict[bytes, int], to) -> Iterator[tuple[int, bytes, bytes]]:
    """Sorted words and counts, packed, for each receiver."""
    lists: dict[int, list[bytes]] = {}
    for w in words:
        lists.setdefault(to(w), []).append(w)
    for k, ws in lists.items():
        ws.sort()
        yield k, zstandard.compress(b" ".join(ws), 1), pack(np.array([words[w] for w in ws], np.int64))


def _word_owner(word: bytes, owners: int) -> int:
    return xxhash.xxh3_64_intdigest(word) % owners


def _words_in(keys: bytes) -> list[bytes]:
    return zstandard.decompress(keys).split(b" ")


ASKED = "block int, kind string, lane int, keys binary, counts binary"


def _ask(depth: int, owners: int, span: int):
    """Of a block: its grams and words with their counts in training texts, a list to each lane of `span` owners."""
    def run(table: pa.Table) -> pa.Table:
        words: Counter = Counter()

        def lists() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in table.to_batches(max_chunksize=2000):
                texts_, train = [t.translate(FOLD) for t in batch.column("text").to_pylist()], batch.column("train").to_pylist()
                for learns in (True, False):
                    for chunk in chunks([t for t, x in zip(texts_, train, strict=True) if x is learns]):
                        g, n = np.unique(grams(chunk, depth)[0], return_counts=True)
                        for t in chunk:
                            if learns:
                                words.update(t.split())
                            else:
                                for w in t.split():
                                    if w not in words:
                                        words[w] = 0
                        yield g, n if learns else np.zeros_like(n)

        block = table.column("block")[0].as_py()
        g, n = _gathered(lists())
        rows = [(block, "gram", *x) for x in _gram_lists(g, n, _owner_of(g, owners) // span)]
        rows += [(block, "word", *x) for x in _word_lists(words, lambda w: _word_owner(w, owners) // span)]
        return _table(rows, ASKED)

    return run, ASKED


RELAYED = "team int, lane int, kind string, owner int, keys binary, counts binary"


def _relay(owners: int):
    """The lists of a team's blocks for one lane as one, a list to each of its owners."""
    def run(table: pa.Table) -> pa.Table:
        team, lane, kind = (table.column(c)[0].as_py() for c in ("team", "lane", "kind"))
        pairs = zip(table.column("keys"), table.column("counts"), strict=True)
        if kind == "gram":
            g, n = _gathered((unpack(k.as_py()), unpack(c.as_py())) for k, c in pairs)
            lists = _gram_lists(g, n, _owner_of(g, owners))
        else:
            lists = _word_lists(_total(pairs), lambda w: _word_owner(w, owners))
        return _table([(team, lane, kind, *x) for x in lists], RELAYED)

    return run, RELAYED


def _total(pairs) -> dict[bytes, int]:
    total: Counter = Counter()
    for k, c in pairs:
        for w, n in zip(_words_in(k.as_py()), unpack(c.as_py()).tolist(), strict=True):
            total[w] += n
    return total


ANSWERED = "team int, lane int, kind string, keys binary, values binary"


def _reply(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """Of a relay: its owners' answers, dealt to the blocks that asked."""
    rows, kind = [], asked.column("kind")[0].as_py()
    if kind == "gram":
        gram = np.concatenate([unpack(k.as_py()) for k in answers.column("keys")])
        value = np.concatenate([np.frombuffer(zstandard.decompress(v.as_py()), np.float32) for v in answers.column("values")])
        order = np.argsort(gram)
        gram, value = gram[order], value[order]
        pick = lambda keys: zstandard.compress(value[np.searchsorted(gram, unpack(keys))].tobytes(), 1)
    else:
        known = _total(zip(answers.column("keys"), answers.column("values"), strict=True))
        pick = lambda keys: pack(np.array([known[w] for w in _words_in(keys)], np.int64))
    for block, keys in zip(asked.column("block"), asked.column("keys"), strict=True):
        rows.append((block.as_py(), kind, keys.as_py(), pick(keys.as_py())))
    return _table(rows, "block int, kind string, keys binary, values binary")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up; x > 0."""
    y = x + 8
    steps = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    big = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return big - np.log(steps)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class Level:
    """The nodes of one depth: keys (context << 8 | decision), counts, weighted log probability, own weight."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> None:
        self.key, self.n0, self.n1 = key, n0, n1
        own = log_kt(n0, n1)
        self.log_weighted = own if below is None else math.log(0.5) + np.logaddexp(own, below)
        self.weight = np.exp(own + math.log(0.5) - self.log_weighted)


class Subtree:
    """All nodes of depth `top` to `depth` above some sorted distinct grams."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, depth: int, top: int) -> None:
        k = np.arange(8)
        byte = (gram & 255)[:, None]
        self.bit = ((byte >> (7 - k)) & 1).ravel()
        self.decision = ((1 << k) | (byte >> (8 - k))).ravel()
        self.context = np.repeat(gram >> 8, 8)
        count = np.repeat(count, 8).astype(float)
        self.levels: dict[int, tuple[Level, np.ndarray]] = {}
        above: Level | None = None
        for d in range(depth, top - 1, -1):
            mask = (1 << (8 * d)) - 1
            key, where = np.unique(((self.context & mask) << 8) | self.decision, return_inverse=True)
            n1 = np.bincount(where, count * self.bit, len(key))
            n0 = np.bincount(where, count * (1 - self.bit), len(key))
            below = None
            if above is not None:
                parent = np.searchsorted(key, (((above.key >> 8) & mask) << 8) | (above.key & 255))
                below = np.bincount(parent, above.log_weighted, len(key))
            above = Level(key, n0, n1, below)
            self.levels[d] = above, where

    def log_probability(self, tops: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of each gram's byte in its context. tops: depth -> sorted keys, and (weight, n0, n1) of each.

        Below the deepest node that training texts have reached there is nothing to mix.
        """
        mixed, seen = None, None
        for d in sorted({*self.levels, *tops}, reverse=True):
            if d in self.levels:
                level, where = self.levels[d]
                weight, n0, n1 = level.weight[where], level.n0[where], level.n1[where]
            else:
                key, values = tops[d]
                weight, n0, n1 = values[:, np.searchsorted(key, ((self.context & ((1 << (8 * d)) - 1)) << 8) | self.decision)]
            own = (np.where(self.bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1.0)
            mixed = own if mixed is None else np.where(seen, weight * own + (1 - weight) * mixed, own)
            seen = n0 + n1 > 0
        return np.log(mixed).reshape(-1, 8).sum(axis=1)


def _received(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _gathered((unpack(k.as_py()), unpack(c.as_py())) for k, c in zip(table.column("keys"), table.column("counts"), strict=True))


#: Owners build the tree down from this depth; what lies above is summed up from them.
TOP = 3


def _summary(depth: int):
    def run(table: pa.Table) -> pa.Table:
        gram, count = _received(table)
        level, _ = Subtree(gram, count, depth, TOP).levels[TOP]
        key, where = np.unique(level.key & 0xFFFFFF, return_inverse=True)
        return pa.table({"node": key, "n0": np.bincount(where, level.n0), "n1": np.bincount(where, level.n1), "below": np.bincount(where, level.log_weighted)})

    return run, "node long, n0 double, n1 double, below double"


def top_levels(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Keys, weights and counts of the depths above TOP, from the sums over all nodes of depth TOP below each of the depth above it."""
    found = {}
    for d in range(TOP - 1, -1, -1):
        level = Level(key, n0, n1, below)
        found[d] = key, np.stack([level.weight, n0, n1])
        key, where = np.unique(key & ((1 << (8 * max(0, d - 1) + 8)) - 1), return_inverse=True)
        n0, n1, below = (np.bincount(where, x, len(key)) for x in (n0, n1, level.log_weighted))
    return found


def _answer(depth: int, tops):
    def run(table: pa.Table) -> pa.Table:
        gram, count = _received(table)
        score = Subtree(gram, count, depth, TOP).log_probability(tops.value).astype(np.float32)
        values = [zstandard.compress(score[np.searchsorted(gram, unpack(k.as_py()))].tobytes(), 1) for k in table.column("keys")]
        return table.select(["team", "lane", "kind", "keys"]).append_column("values", pa.array(values, pa.binary()))

    return run, ANSWERED


def _count(table: pa.Table) -> pa.Table:
    """Of an owner of words: each relay's counts, and its part of the totals in a row without relay."""
    total = _total(zip(table.column("keys"), table.column("counts"), strict=True))
    rows = [(t.as_py(), lane.as_py(), "word", k.as_py(), pack(np.array([total[w] for w in _words_in(k.as_py())], np.int64))) for t, lane, k in zip(*(table.column(c) for c in ("team", "lane", "keys")), strict=True)]
    known = [n for n in total.values() if n]
    return _table([*rows, (None, None, "sum", b"", pack(np.array([len(known), sum(known)], np.int64)))], ANSWERED)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bytes long, bits_per_byte double"


def _score(depth: int, distinct: int, tokens: int, ends: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: list = []
        gram, value, words = [], [], {}
        for kind, keys, values in zip(*(answers.column(c).to_pylist() for c in ("kind", "keys", "values")), strict=True):
            if kind == "gram":
                gram.append(unpack(keys))
                value.append(np.frombuffer(zstandard.decompress(values), np.float32))
            else:
                words.update((w, c) for w, c in zip(zstandard.decompress(keys).split(b" "), unpack(values).tolist(), strict=True) if c)
        if len(docs):
            gram, value = np.concatenate(gram), np.concatenate(value).astype(float)
            order = np.argsort(gram)
            gram, value = gram[order], value[order]
        room = math.log10(tokens + distinct + 1)
        for batch in docs.to_batches(max_chunksize=2000):
            ids, train = batch.column("doc_id").to_pylist(), batch.column("train").to_pylist()
            folded, scores = [t.translate(FOLD) for t in batch.column("text").to_pylist()], []
            for chunk in chunks(folded):
                g, at = grams(chunk, depth)
                scores.append(np.add.reduceat(value[np.searchsorted(gram, g)], at))
            scores = np.concatenate(scores) / math.log(10)
            for i, x, t, s in zip(ids, train, folded, scores.tolist(), strict=True):
                own = t.split()
                c = np.array([*map(words.get, own, [0] * len(own)), ends], float)
                base = float(np.log10(c + 1).sum()) - len(c) * room
                out.append((i, not x, len(c), int((c > 0).sum()), tokens, base, s, len(t) + 1, -s * math.log2(10) / (len(t) + 1)))
        return _table(out, SCORES)

    return run


def scores(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bytes, bits_per_byte of every row.

    Texts are scored whole, A-Z lower-cased, with one end behind the last byte; null counts as empty,
    which has the end alone. Training rows are those whose crc32(doc_id as text) mod 7 is not 2. Rows
    that repeat are learnt and scored each. Without training rows every decision costs one bit. Other
    columns are ignored; an empty table gives an empty result.
    """
    if not TOP <= depth <= 6:
        raise ValueError(f"depth must be {TOP} to 6")
    spark, source = docs.sparkSession, texts(docs)
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD_OUT
    total = source.agg(F.sum(F.octet_length("text") + 64).alias("bytes"), F.count_if(train).alias("ends")).first()
    if total.bytes is None:
        return spark.createDataFrame([], SCORES)
    n = -(-total.bytes // block_bytes)
    owners = max(LEAST_OWNERS, BLOCK_OWNERS * n)
    team, span = math.isqrt(n - 1) + 1, math.isqrt(owners - 1) + 1
    dealt = source.withColumn("train", train).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    asked = materialize(dealt.groupBy("block").applyInArrow(*_ask(depth, owners, span)), "asked").withColumn("team", F.floor(F.col("block") / team).cast("int"))
    relayed = materialize(asked.groupBy("team", "lane", "kind").applyInArrow(*_relay(owners)), "relayed")
    of_grams, of_words = relayed.where("kind = 'gram'"), relayed.where("kind = 'word'")
    summed = of_grams.groupBy("owner").applyInArrow(*_summary(depth)).groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below"))
    top = summed.orderBy("node").toArrow()
    tops = spark.sparkContext.broadcast(top_levels(*(np.array(top.column(c)) for c in ("node", "n0", "n1", "below"))))
    counted = materialize(of_words.groupBy("owner").applyInArrow(_count, ANSWERED), "counted")
    sums = [unpack(bytes(r["values"])) for r in counted.where("kind = 'sum'").select("values").toLocalIterator()]
    distinct, tokens = sum(int(s[0]) for s in sums), sum(int(s[1]) for s in sums)
    answers = of_grams.groupBy("owner").applyInArrow(*_answer(depth, tops)).unionByName(counted.where("kind = 'word'"))
    relay = ("team", "lane", "kind")
    replies = asked.groupBy(*relay).cogroup(answers.groupBy(*relay)).applyInArrow(_reply, "block int, kind string, keys binary, values binary")
    scored = dealt.groupBy("block").cogroup(replies.groupBy("block"))
    return scored.applyInArrow(_score(depth, distinct + (total.ends > 0), tokens + total.ends, total.ends), SCORES)
