"""Token counts by offset-mapped attribution: a document is encoded once, whole, and its tokens' spans
are joined to sections of the text; a rule allocates tokens that cross a boundary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: A table of ranks; where executors find it is a parameter.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer's split of this vocabulary, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "most", "split")
_loaded: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and each token's length in bytes; loaded once in a worker."""
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _loaded[path]


#: White space of the pre-tokenizer; in a run of as many the search for its end overflows, and it is cut out before.
LONG_RUN = 1000
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def token_ends(text: str, path: str, long_run: int = LONG_RUN) -> np.ndarray:
    """Byte offsets at which the text's tokens end.

    A run of white space is one pre-token but for its last character, which belongs to what follows;
    so a long run is encoded as that piece, and the text before and behind it as ever.
    """
    enc, sizes = encoding(path)
    parts, at = [], 0
    for run in re.finditer(f"{WHITE}{{{long_run},}}", text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        parts += [enc.encode_to_numpy(text[at : run.start()], disallowed_special=()), np.array(enc._encode_single_piece(text[run.start() : stop]), np.int64)]
        at = stop
    parts.append(enc.encode_to_numpy(text[at:], disallowed_special=()))
    return np.cumsum(sizes[np.concatenate(parts).astype(np.int64)])


def allocate(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section (in order, not overlapping; bytes), and how many of those that touch it cross a boundary.

    start: a token counts where its first byte is; most: where most of its bytes are, the earlier of
    equals; split: in each section by its share of bytes. Bytes in gaps belong to no section.
    """
    first = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    counts, crossing = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
    if not len(ends) or not len(starts):
        return counts, crossing
    a = np.searchsorted(stops, first, "right")  # the section that has the first byte, or the next one
    b = np.searchsorted(starts, ends, "left") - 1  # the last section that the token touches
    within = (a == b) & (starts[np.minimum(a, len(starts) - 1)] <= first) & (stops[np.minimum(a, len(starts) - 1)] >= ends)
    counts += np.bincount(a[within], minlength=len(starts))
    for k in np.flatnonzero(~within & (a <= b)):
        touched = np.arange(a[k], b[k] + 1)
        shares = np.minimum(stops[touched], ends[k]) - np.maximum(starts[touched], first[k])
        touched, shares = touched[shares > 0], shares[shares > 0]
        crossing[touched] += 1
        if rule == "split":
            counts[touched] += shares / (ends[k] - first[k])
        elif rule == "most" and len(touched):
            gap = ends[k] - first[k] - shares.sum()
            if shares.max() >= gap:
                counts[touched[shares.argmax()]] += 1
        elif len(touched) and starts[touched[0]] <= first[k]:
            counts[touched[0]] += 1
    return counts, crossing


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sections of code points: the lines with their ends; a text without characters is one empty section."""
    sizes = [len(x) + 1 for x in text.split("\n")]
    sizes[-1] -= 1
    stops = np.cumsum(sizes if len(sizes) == 1 or sizes[-1] else sizes[:-1])
    return np.concatenate([[0], stops[:-1]]), stops


OUT = "doc_id long, section int, start long, end long, n_tokens double, n_crossing long, doc_tokens long"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64()), ("doc_tokens", pa.int64())])


def _attribute(path: str, rule: str, given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in SCHEMA]
            spans = batch.column("spans").to_pylist() if given else [None] * len(batch)
            for i, raw, own in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), spans, strict=True):
                text = raw.decode()
                if given:
                    pairs = sorted((s["start"], s["end"]) for s in own or ())
                    starts, stops = np.array([p[0] for p in pairs], np.int64).clip(0, len(text)), np.array([p[1] for p in pairs], np.int64).clip(0, len(text))
                    if len(pairs):  # what overlaps the section before starts where that ends
                        stops = np.maximum.accumulate(stops)
                        starts = np.minimum(np.maximum(starts, np.concatenate([[0], stops[:-1]])), stops)
                else:
                    starts, stops = lines(text)
                ends = token_ends(text, path)
                if len(raw) == len(text):
                    byte = lambda x: x
                else:
                    at = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
                    byte = at.__getitem__
                counts, crossing = allocate(ends, byte(starts), byte(stops), rule)
                n = len(starts)
                for column, values in zip(columns, ([i] * n, range(n), starts.tolist(), stops.tolist(), counts.tolist(), crossing.tolist(), [len(ends)] * n), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

    return run


def attribute(docs: DataFrame, sections: DataFrame | None = None, rule: str = "most", path: str = RANKS) -> DataFrame:
    """doc_id, section (by start), start and end in code points, n_tokens, n_crossing, doc_tokens of every section.

    sections has doc_id, start, end; without it a document's lines are its sections. Rules: allocate().
    Without gaps a document's n_tokens sum up to doc_tokens. Long texts are encoded whole. Null and empty texts have one empty section of no tokens;
    documents that sections doesn't list have none. Sections reach to the text's end at most, and
    one that overlaps another starts where that ends. Rows that repeat a doc_id are counted each; other
    columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = texts(docs)
    if sections is not None:
        spans = sections.where("start IS NOT NULL AND end IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("span_id")).agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("spans"))
        rows = rows.join(spans, F.col("doc_id") == F.col("span_id")).select("doc_id", "text", "spans")
    return rows.mapInArrow(_attribute(path, rule, sections is not None), OUT)
