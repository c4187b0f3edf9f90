"""Benchmark decontamination: one Aho-Corasick automaton over normalised items scans every text once.

Words are runs of a-z, 0-9 and all characters beyond ASCII, after lower-casing A-Z; a normalised text
is its words with single spaces around them, so a match of a window starts and ends at a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, texts, without

WINDOW = 13
#: Windows in one automaton at most; larger benchmarks are scanned in as many passes as they need.
MAX_WINDOWS = 200_000
WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz"
TO_WORDS = bytes(FOLD[c] if c > 127 or FOLD[c] in WORD_BYTES else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def windows_of(text: bytes, size: int = WINDOW) -> list[str]:
    words = [w.decode() for w in words_of(text)]
    if not words:
        return []
    return [f" {' '.join(words[k : k + size])} " for k in range(max(1, len(words) - size + 1))]


_built: list[tuple[dict[str, list[str]], ahocorasick.Automaton]] = []


def automaton(windows: dict[str, list[str]]) -> ahocorasick.Automaton:
    """Of (window: its items); a worker builds it once for a broadcast, which it keeps."""
    for known, got in _built:
        if known is windows:
            return got
    a = ahocorasick.Automaton()
    for w, items in windows.items():
        a.add_word(w, (len(w), w.count(" ") - 1, tuple(items)))
    a.make_automaton()
    _built[:] = [(windows, a)]
    return a


def hits(words: list[bytes], scan) -> list[tuple[int, int, tuple[str, ...]]]:
    """(first word, words, items) of every occurrence of a window."""
    line = b" " + b" ".join(words) + b" "
    found = list(scan(line.decode()))
    if not found:
        return []
    ends = np.cumsum([len(w.decode()) + 1 for w in words])  # offset of the space after each word
    out = []
    for end, (_, n, items) in found:
        last = int(np.searchsorted(ends, end))
        out.append((last - n + 1, n, items))
    return out


def _found(windows: dict[str, list[str]], raw: Iterator[bytes]) -> Iterator[tuple[list[bytes], list]]:
    """Of each text its words and hits."""
    scan = automaton(windows).iter if windows else lambda _: ()
    for text in raw:
        words = words_of(text)
        yield words, hits(words, scan) if words else []


def _verdict(words: list[bytes], found: list) -> tuple[int, int, list[str]]:
    """Words, hit words, items."""
    hit = np.zeros(len(words) + 1, np.int64)
    for a, n, _ in found:
        hit[a] += 1
        hit[a + n] -= 1
    return len(words), int((np.cumsum(hit) > 0).sum()), sorted({i for _, _, items in found for i in items})


def _spans(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, rows = batch.column("text").to_pylist(), []
            for key, doc_id, text, (_, found) in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), raw, _found(shared.value, raw), strict=True):
                if found:
                    places = [m.span() for m in WORD.finditer(text.translate(FOLD).decode())]
                    rows += [(key, doc_id, item, a, a + n, places[a][0], places[a + n - 1][1]) for a, n, items in found for item in items]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), *(pa.array(c, pa.int32()) for c in cols[3:])], names=["key", "doc_id", "item_id", "first_word", "end_word", "start", "end"])

    return run


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_verdict(*x) for x in _found(shared.value, batch.column("text").to_pylist())]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.string()))], names=["key", "doc_id", "n_words", "n_hit", "items"])

    return run


def _windows(benchmark: DataFrame, size: int, most: int) -> list[dict[str, list[str]]]:
    """Window: items, in shards of at most `most` windows. The driver reads the benchmark, not the corpus."""
    shards: list[dict[str, list[str]]] = [{}]
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct().toLocalIterator():
        for w in sorted(set(windows_of(row.text.encode(), size))):
            if len(shards[-1]) >= most:
                shards.append({})
            shards[-1].setdefault(w, []).append(row.item_id)
    return shards


def keyed(docs: DataFrame) -> DataFrame:
    """texts() with a key that rows share only where id and text are the same, and so are the hits."""
    return texts(docs).withColumn("key", F.xxhash64("doc_id", "text"))


SPANS = "key long, doc_id long, item_id string, first_word int, end_word int, start int, end int"
COUNTS = "key long, doc_id long, n_words long, n_hit long, items array<string>"


def _occurrences(docs: DataFrame, shards: list[dict[str, list[str]]]) -> DataFrame:
    sc, out = docs.sparkSession.sparkContext, None
    for shard in shards:
        part = keyed(docs).mapInArrow(_spans(sc.broadcast(shard)), SPANS)
        out = part if out is None else out.unionByName(part)
    return out


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, item_id, words first_word to end_word and code points start to end of the original text, of every match."""
    return _occurrences(docs, _windows(benchmark, window, max_windows)).drop("key")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row.

    A document is contaminated when some window hits it and the hit words are 5 % of its words or more.
    Null and wordless texts have no words and are clean; items without words have no windows; an item
    id that repeats with other texts has the windows of all; a null item_id is the item ''. Rows that
    repeat an id, or have none, are scored each. An empty benchmark hits nothing; empty documents give
    an empty result; other columns are ignored.
    A benchmark of over max_windows windows is scanned in shards, and its hits are merged by word.
    """
    shards = _windows(benchmark, window, max_windows)
    out = _verdicts(docs, shards)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.expr(BAD).alias("contaminated"))


#: Hit words that make a document contaminated.
BAD = "n_hit > 0 AND n_hit * 20 >= n_words"


def _verdicts(docs: DataFrame, shards: list[dict[str, list[str]]]) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    if len(shards) == 1:
        return keyed(docs).mapInArrow(_scan(sc.broadcast(shards[0])), COUNTS)
    parts = keyed(docs).mapInArrow(_scan(sc.broadcast({})), COUNTS).select("key", "doc_id", "n_words")
    where = _occurrences(docs, shards).select(F.col("key").alias("of"), "item_id", F.explode(F.sequence("first_word", F.col("end_word") - 1)).alias("word"))
    found = where.groupBy("of").agg(F.countDistinct("word").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items"))
    out = parts.join(found, F.col("key") == F.col("of"), "left")
    return out.select("key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            rows = [_verdict(*x) for x in _found(shared.value, raw)]
            yield batch.filter(pa.array([not hit or hit * 20 < n for n, hit, _ in rows], pa.bool_()))

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents that are not contaminated, with their columns, by the rules of contamination(): each row by its own text."""
    shards = _windows(benchmark, window, max_windows)
    if len(shards) == 1:
        return docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(shards[0])), docs.schema)
    marked = docs.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return without(marked, _verdicts(docs, shards).where(BAD).select(F.col("key").alias("__key")), "__key").select(docs.columns)


ORACLE_BODY = r"""
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {docs}),
bw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k : k + 12], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM bw WHERE len(w) > 0)),
dwin AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, (SELECT DISTINCT n FROM bwin) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, k, bwin.n AS n FROM dwin JOIN bwin USING (win) WHERE dwin.n = bwin.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
"""
ORACLE = (
    "WITH "
    + ORACLE_BODY.format(docs="documents").strip()
    + """
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
)
