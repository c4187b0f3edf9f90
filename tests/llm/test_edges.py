"""Repeated and null ids, clashing columns, ties, long texts and empty tables, each against brute force."""

import hashlib
import random

import numpy as np
import pytest

from prismlake.llm import decontaminate, exact_dedup, jaccard, mixing, tokens

SCHEMA = "doc_id long, text string, source string, n long, class string, key string, sha string, size long, keep_id long, component string, n_words string, taken long, target string"
A = " ".join(f"a{k}" for k in range(60))
NEAR = A.replace("a59", "b59")
OTHER = " ".join(f"z{k}" for k in range(40))


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", "y", "z", 9, 8, "q", "w", 7, "v") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return [(1, A, "s"), (1, OTHER, "s"), (2, NEAR, "s"), (3, OTHER.upper(), None), (None, A, "s"), (None, "alone here and now", "t"), (None, "alone here and now", "t"), (5, "only five", "t"), (5, "only five", "t"), (7, None, "t"), (8, "", None), (9, "  \n", "s"), (9, A, "s")]


def test_links_of_repeated_and_null_ids(spark, rows):
    got = sorted((tuple(r) for r in jaccard.linked(table(spark, rows), 3, 90).collect()), key=str)
    want = {1: 1, 2: 1, 3: 1, 5: 5, 7: 7, 8: 8, 9: 1}
    assert len(got) == len(rows)
    for i, n, component in got:
        assert component == (want[i] if i is not None else 1 if n == 58 else None)
    again = [(1, A, ""), (1, OTHER, ""), (2, A + " z", ""), (3, OTHER + " z", "")]
    assert {r.component_id for r in jaccard.linked(table(spark, again), 3, 90).collect()} == {1}
    kept = sorted((r.doc_id, r.text) for r in jaccard.keep_first(table(spark, rows), 3, 90).collect() if r.doc_id is not None)
    assert kept == sorted([(1, A), (1, OTHER), (5, "only five"), (5, "only five"), (7, None), (8, "")], key=lambda x: (x[0], x[1] or ""))
    assert [r.text for r in jaccard.keep_first(table(spark, rows), 3, 90).where("doc_id IS NULL").collect()] == ["alone here and now"] * 2


def test_exact_groups_of_repeated_and_null_ids(spark, rows):
    for r in exact_dedup.exact_groups(table(spark, rows)).collect():
        same = [i for i, t, _ in rows if hashlib.sha256((t or "").lower().encode()).hexdigest() == r.text_sha256]
        known = [i for i in same if i is not None]
        keep = max(known) if known else None
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), r.doc_id == keep)
    kept = sorted((str(r.doc_id), str(r.text)) for r in exact_dedup.keep_last(table(spark, rows)).collect())
    assert kept == sorted([("2", NEAR), ("3", OTHER.upper()), ("None", "alone here and now"), ("5", "only five"), ("8", ""), ("9", "  \n"), ("9", A)])
    big = [(2**60 + 1, "x", ""), (2**60 + 2, "x", ""), (None, "x", "")]
    assert {r.keep_id for r in exact_dedup.exact_groups(table(spark, big)).collect()} == {2**60 + 2}
    assert {r.doc_id for r in exact_dedup.keep_last(table(spark, big)).collect()} == {2**60 + 2}


def test_hot_groups_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_HOT", 3)
    docs = [(k, "hot" if k % 3 else f"t{k % 5}", "") for k in range(90)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(table(spark, docs)).collect()}
    groups = {}
    for i, t, _ in docs:
        groups.setdefault(t, []).append(i)
    assert got == {i: (max(groups[t]), len(groups[t])) for i, t, _ in docs}


def test_a_text_of_half_the_rows_is_one_hash_of_each_task(spark):
    docs = table(spark, [(k, "hot" if k % 2 else f"t{k}", "") for k in range(8000)]).repartition(4)
    run, schema = exact_dedup._send(30, 8)
    sent = exact_dedup.texts(docs).mapInArrow(run, schema).where("payload is not null")
    load = [r.n for r in sent.groupBy("owner").agg({"pos": "sum"}).toDF("owner", "n").collect()]
    assert len(load) == 8 and max(load) <= 2 * sum(load) / 8 and sum(load) == 4000 + 4
    got = exact_dedup.exact_groups(docs).where("group_size > 1").agg({"*": "count", "keep_id": "max", "group_size": "max"}).first()
    assert sorted(got) == [4000, 4000, 7999]


def test_contamination_of_repeated_and_null_ids(spark, rows):
    bench = spark.createDataFrame([(None, "only five"), ("q", OTHER), ("q", "alone here"), ("r", "")], "item_id string, text string")
    extra = [*rows, (5, "clean text of many other words"), (None, "only five words")]
    extra = [(x[0], x[1], "s") for x in extra]
    want = []
    for _, t, _ in extra:
        w = (t or "").lower().split()
        want.append((len(w), 40 if w and w[0] == "z0" else 2 if w[:2] in (["only", "five"], ["alone", "here"]) else 0))
    for most in (100_000, 1, 7):
        got = [(r.n_words, r.n_hit) for r in decontaminate.contamination(table(spark, extra), bench, max_windows=most).collect()]
        assert sorted(got) == sorted(want)
        kept = [r.text for r in decontaminate.keep_clean(table(spark, extra), bench, max_windows=most).collect()]
        assert sorted(map(str, kept)) == sorted(str(t) for (_, t, _), (n, h) in zip(extra, want, strict=True) if not h)
    no = bench.limit(0)
    assert decontaminate.keep_clean(table(spark, extra), no).count() == len(extra) and decontaminate.contamination(table(spark, []), bench).count() == 0


def test_another_benchmark_is_not_scanned_with_the_old_automaton():
    for k in range(50):
        windows = {f" w{k} ": [str(k)]}
        assert decontaminate.hits([b"w%d" % k], decontaminate.automaton(windows).iter) == [(0, 1, (str(k),))]
        del windows


def test_mix_of_repeated_and_null_rows(spark, rows):
    out = mixing.mix(table(spark, rows)).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in out)
    assert sum(r.taken for r in out) == pytest.approx(1.5 * sum(r.size for r in out), abs=3)


@pytest.mark.parametrize("text", [" " * 1_000_000, "x" + "\n" * 300_000 + "y", " \t" * 2000 + "é z  ", "a" * 200_000])
def test_long_runs_are_encoded(text):
    ends = tokens.token_ends(text, tokens.RANKS)
    assert ends[-1] == len(text.encode()) and (np.diff(ends) > 0).all()


def test_runs_cut_out_change_no_token():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice([" ", "\n", "\t", "  ", "ab", "é", "1", ".", " ", "'s"]) for _ in range(40))
        enc, sizes = tokens.encoding(tokens.RANKS)
        whole = np.cumsum(sizes[enc.encode_to_numpy(text, disallowed_special=())])
        assert (tokens.token_ends(text, tokens.RANKS, 3) == whole).all()


def test_attribution_is_that_of_brute_force(spark):
    rng, docs, spans = random.Random(4), [], []
    for k in range(25):
        text = "".join(rng.choice(["word ", "längere ", "\n", "😀", "  ", "12345", "!? "]) for _ in range(rng.randrange(30)))
        docs.append((k, text))
        at = 0
        while at < len(text) and rng.random() < 0.9:
            a = at + rng.randrange(3)
            at = a + 1 + rng.randrange(9)
            spans.append((k, a, min(at, len(text))))
    spans = [s for s in spans if s[1] < s[2]]
    d, s = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(spans, "doc_id long, start long, end long")
    for rule in tokens.RULES:
        got = {(r.doc_id, r.start): r.n_tokens for r in tokens.attribute(d, s, rule).collect()}
        for i, text in docs:
            own = [(a, b, len(text[:a].encode()), len(text[:b].encode())) for j, a, b in spans if j == i]
            want, first = dict.fromkeys((o[0] for o in own), 0.0), 0
            for end in tokens.token_ends(text, tokens.RANKS).tolist():
                share = {o[0]: min(o[3], end) - max(o[2], first) for o in own if min(o[3], end) > max(o[2], first)}
                if rule == "split":
                    for a, x in share.items():
                        want[a] += x / (end - first)
                elif rule == "start":
                    for o in own:
                        want[o[0]] += o[2] <= first < o[3]
                elif share and max(share.values()) >= end - first - sum(share.values()):
                    want[max(share, key=lambda a: (share[a], -a))] += 1
                first = end
            for a, n in want.items():
                assert got[i, a] == pytest.approx(n)
