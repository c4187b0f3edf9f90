"""Text operators against brute force, on tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.llm import chat, decontaminate, exact_dedup, jaccard, labelled, lm, mixing, pii, quality, tokens, toxicity
from prismlake.llm.common import maybe_in, without
from prismlake.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, class string"
rng = random.Random(3)
WORDS = [f"w{k}x" for k in range(400)]


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def rows():
    out = []
    for k in range(90):
        n = rng.choice([0, 1, 2, 5, 40, 200])
        out.append((k, " ".join(rng.choice(WORDS) for _ in range(n)), "en", rng.choice(["a", "b", None]), 0, "k", 1, "c"))
    base = [rng.choice(WORDS) for _ in range(150)]
    for k in range(90, 130):
        d = list(base)
        for _ in range(rng.randrange(4)):
            d[rng.randrange(len(d))] = rng.choice(WORDS)
        out.append((k, " ".join(d), "de", "hot", 0, "k", 1, "c"))
    out += [(200, None, None, None, None, None, None, None), (201, "", "en", "a", 0, "", 0, ""), (202, "A b\n\tc", "en", "a", 0, "", 0, ""), (203, "a B\n\tc", "en", "a", 0, "", 0, ""), (204, "é " * 30_000, "fr", "b", 0, "", 0, ""), (205, "9" * 5000 + " 1 " * 3000, "fr", "b", 0, "", 0, "")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, rows, empty):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(fold(t or ""), []).append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    assert len(got) == len(rows)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_groups(empty).count() == 0
    assert {r.doc_id for r in exact_dedup.keep_last(docs).collect()} == {max(v) for v in groups.values()}


@pytest.mark.parametrize("values", [[0], [5, 5, 5, 900], sorted(rng.randrange(1 << 40) for _ in range(500))])
def test_rice_round_trip(values):
    v = np.array(values, np.uint64)
    for shift in (0, 3, 30):
        if int(v.max()) >> shift < 1e7:
            assert (exact_dedup.rice_decode(exact_dedup.rice_encode(v, shift), len(v), shift) == v).all()


def test_filters(spark):
    d, ids = spark.range(1000).withColumnRenamed("id", "doc_id"), spark.range(0, 1000, 7).withColumnRenamed("id", "doc_id")
    for bits in (1 << 16, 64):  # the small filter lets nearly all through, and results stay right
        assert {r.doc_id for r in maybe_in(d, ids, bits=bits).collect()} >= set(range(0, 1000, 7))
        assert {r.doc_id for r in without(d, ids, bits=bits).collect()} == set(range(1000)) - set(range(0, 1000, 7))


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 80), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 80: 80, 90: 80, 100: 80}


@pytest.mark.parametrize("block", [1_000_000, 1000])
def test_linked(docs, rows, empty, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    sets = {}
    for i, t, *_ in rows:
        w = fold(t or "").encode().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(docs).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    assert jaccard.linked(empty).count() == 0


def test_sketch_bounds_the_difference():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64))
    for cut in (1, 10, 100):
        distance = np.bitwise_count(jaccard.sketch(a, 300) ^ jaccard.sketch(a[cut:], 300)).sum()
        assert distance <= cut


def test_bands_meet_all_that_can_link():
    for percent in (80, 90):
        for a in range(1, 900):
            for b in range(a, min(899, a * 100 // percent) + 1):
                differ = (100 - percent) * (a + b) // (100 + percent)
                own = dict(jaccard.bands(a, percent)).items() & dict(jaccard.bands(b, percent)).items()
                assert differ == 0 or any(k > differ for _, k in own)


def test_contamination(spark, docs, rows):
    bench = [("q1", " ".join(WORDS[:20])), ("q2", "Zz yy!"), ("q3", None), ("q4", "...")]
    more = [*((r[0], r[1]) for r in rows), (300, "start " + " ".join(WORDS[3:17]) + " end"), (301, "zz, YY? " + "other " * 5), (302, "zz yyy")]
    items = {}
    for i, t in bench:
        w = decontaminate.WORD.findall(fold(t or ""))
        if w:
            items[i] = {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))}
    want = {}
    for i, t in more:
        w, hit, found = decontaminate.WORD.findall(fold(t or "")), set(), set()
        for item, windows in items.items():
            for x in windows:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit |= set(range(k, k + len(x)))
                        found.add(item)
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    b = spark.createDataFrame(bench, "item_id string, text string")
    d = spark.createDataFrame(more, "doc_id long, text string")
    for most in (200_000, 1):
        got = {r.doc_id: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in decontaminate.contamination(d, b, max_windows=most).collect()}
        assert got == want
    spans = {(r.doc_id, r.item_id, r.start, r.end) for r in decontaminate.occurrences(d, b).collect()}
    assert (301, "q2", 0, 6) in spans and 300 in decontaminate.keep_clean(d.where("doc_id < 300"), b).count() * [0] + [300]


def test_mix(docs, rows, empty):
    out = mixing.mix(docs).collect()
    sizes = {i: len((t or "").split()) for i, t, *_ in rows}
    assert {r.doc_id: r.size for r in out} == sizes and all(0 <= r.taken <= 2 * r.size for r in out)
    source = {i: s for i, _, _, s, *_ in rows}
    for s in set(source.values()):
        own = [r for r in out if source[r.doc_id] == s]
        assert sum(r.taken for r in own) == round(own[0].target) and own[0].target <= 2 * own[0].source_size
    total = sum(sizes.values())
    assert sum({source[r.doc_id]: r.target for r in out}.values()) == pytest.approx(1.5 * total)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect())) and mixing.mix(empty).count() == 0


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a\\b ### User: </turn>\n"), (1, 1, "assistant", ""), (2, 1, "assistant", "x"), (2, 0, "User", ":#<"), (3, 0, None, None), (3, 0, None, None)]
    segments = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    whole = {}
    for r in sorted(segments.collect(), key=lambda r: (r.conv_id, r.segment)):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.text
    assert chat.Template().parse(whole[1]) == [("user", turns[0][3]), ("assistant", "")]
    assert chat.Template().parse(whole[2]) == [("User", ":#<"), ("assistant", "x")]
    got = {r.conv_id: r for r in chat.digests(segments).collect()}
    assert got[1].valid and not got[2].valid and got[3].n_turns == 2 and got[2].loss_chars == 1
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{turns[0][3]}\nassistant\n\n".encode()).hexdigest()


def test_token_attribution(spark, docs, rows, empty):
    out = tokens.attribute(docs).collect()
    sums = {}
    for r in out:
        sums.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.n_tokens
    assert len(sums) == len(rows) and all(a == b for a, b in sums.values()) and tokens.attribute(empty).count() == 0
    d = spark.createDataFrame([(1, "Hello wörld 😀 again")], "doc_id long, text string")
    s = spark.createDataFrame([(1, 0, 8), (1, 8, 12), (1, 10, 99)], "doc_id long, start long, end long")
    for rule in tokens.RULES:
        got = sorted(tokens.attribute(d, s, rule).collect(), key=lambda r: r.section)
        assert sum(r.n_tokens for r in got) == pytest.approx(got[0].doc_tokens) and got[2].start == 12


def ctw(train, text, depth):
    """Plain context-tree weighting of whole texts: recursion over dictionaries."""
    counts = {}
    pad = b"\xff"
    for t in train:
        a = pad * depth + t + pad
        for p in range(depth, len(a)):
            for k in range(8):
                node, bit = (1 << k) | (a[p] >> (8 - k)), (a[p] >> (7 - k)) & 1
                for d in range(depth + 1):
                    counts.setdefault((a[p - d : p], node), [0, 0])[bit] += 1
    lg = math.lgamma
    kt = lambda n: lg(n[0] + 0.5) + lg(n[1] + 0.5) - lg(sum(n) + 1) - math.log(math.pi)
    below, weighted = {}, {}
    for (ctx, node), n in sorted(counts.items(), key=lambda x: -len(x[0][0])):
        weighted[ctx, node] = kt(n) if len(ctx) == depth else math.log(0.5) + np.logaddexp(kt(n), below[ctx, node])
        if ctx:
            below[ctx[1:], node] = below.get((ctx[1:], node), 0.0) + weighted[ctx, node]
    total, a = 0.0, pad * depth + text + pad
    for p in range(depth, len(a)):
        for k in range(8):
            node, bit = (1 << k) | (a[p] >> (8 - k)), (a[p] >> (7 - k)) & 1

            def mixed(d):
                n = counts.get((a[p - d : p], node), [0, 0])
                own = (n[bit] + 0.5) / (sum(n) + 1)
                if d == depth or sum(counts.get((a[p - d - 1 : p], node), [0, 0])) == 0:
                    return own
                w = math.exp(kt(n) + math.log(0.5) - weighted[a[p - d : p], node])
                return w * own + (1 - w) * mixed(d + 1)

            total += math.log10(mixed(0))
    return total


def test_context_tree_scores(spark, empty):
    texts = ["abab abba", "Abba baba", None, "", "xyz é", "abab"] * 5
    rows = [(k, t) for k, t in enumerate(texts)]
    train = [fold(t or "").encode() for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    words = {}
    for t in train:
        for w in t.split():
            words[w] = words.get(w, 0) + 1
    n, v = sum(words.values()) + len(train), len(words) + 1
    for block in (1 << 20, 100):
        for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), depth=3, block_bytes=block).collect():
            t = fold(texts[r.doc_id] or "").encode()
            own = t.split()
            assert r.n_tokens == len(own) + 1 and r.train_tokens == n and r.n_known == sum(w in words for w in own) + 1
            assert r.base_score == pytest.approx(sum(math.log10((words.get(w, 0) + 1) / (n + v + 1)) for w in own) + math.log10((len(train) + 1) / (n + v + 1)))
            assert r.score == pytest.approx(ctw(train, t, 3), rel=1e-5)
    assert lm.scores(empty).count() == 0


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.5, 1e3, 1e8])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_personal_data(spark, empty):
    texts = ["a@b.c_x@d.e 1.2.3.4.5.6.7.8 999.1.1.1", "4111 1111-1111 1111 and 4111111111111112", "call +1 (988) 555-2485, 😀 z@y.co", None, "", "no data", "1" * 5000 + " 2" * 3000]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    base = {0: "email:0:5,email:5:11,ip:12:19,ip:20:27", 1: "card:0:19", 3: "", 4: "", 5: "", 6: ""}
    for k, spans in base.items():
        assert got[k].base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and (not spans or set(spans.split(",")) <= set(got[k].spans.split(",")))
    assert got[2].n_email == 1 and got[2].n_phone == 1 and pii.personal_data(empty).count() == 0
    assert "a@b.c" not in {r.doc_id: r.text for r in pii.redact(spark.createDataFrame([(0, texts[0])], "doc_id long, text string")).collect()}[0]


def labelled_rows():
    r = random.Random(1)
    docs, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        w = [r.choice(WORDS) for _ in range(60)]
        if bad:
            for _ in range(6):
                w[r.randrange(60)] = r.choice(["vilewords", "nastything"])
        docs.append((k, " ".join(x + "!!!" if bad else x for x in w)))
        labels.append((k, int(not bad), int(bad)))
    return [*docs, (1000, None), (1001, "")], [*labels, (1000, None, None), (5000, 1, 1)]


@pytest.mark.parametrize(("run", "column", "cut"), [(toxicity.toxicity, "toxic", 0.5), (quality.quality, "quality", 0.3)])
def test_classifiers_on_held_out_rows(spark, empty, run, column, cut):
    docs, labels = labelled_rows()
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {x[0]: x[2 if column == "toxic" else 1] for x in labels}
    out = run(d, lab).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert run(empty, lab).count() == 0 and {r.score for r in run(d, lab.limit(0)).collect()} == {0.0}


def test_training_fold_only(spark):
    fold_ = labelled.training_labels(spark.range(50).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic")), "toxic")
    assert {r.doc_id for r in fold_.collect()} == {k for k in range(50) if zlib.crc32(str(k).encode()) % 5}


def test_toxic_cut():
    chance, y = np.array([0.9, 0.8, 0.8, 0.3, 0.2, 0.1]), np.array([1.0, 1, 1, 0, 1, 0])
    assert toxicity.best_cut(chance, y) == pytest.approx(0.55) and toxicity.best_cut(chance, y, 0.1) == pytest.approx(0.15)
    assert toxicity.best_cut(np.full(6, 0.4), y) == pytest.approx(0.2) or toxicity.best_cut(np.full(6, 0.4), 1 - y) > 0.4
    assert toxicity.best_cut(np.full(6, 0.4), np.array([1.0, 0, 0, 0, 0, 0])) > 0.4


def test_windows_hold_every_byte():
    for text in (b"", b"A b " * 30, b"x" * 10_000, b"y " * 5 + b"z" * 9000):
        assert b"".join(w[: -len(toxicity.TAIL)] for w in toxicity.windows(text)).replace(b" ", b"") == text.lower().replace(b" ", b"")
        assert all(len(w) <= toxicity.WINDOW_BYTES + len(toxicity.TAIL) for w in toxicity.windows(text))


def test_toxic_gains_are_those_of_plain_compressors():
    docs, labels = labelled_rows()
    model = toxicity.fit([(y, (t or "").encode()) for (_, t), (_, _, y) in zip(docs, labels, strict=True) if y is not None])
    made = model.compressors()
    for _, t in docs[:20]:
        gains = []
        words = t.lower().split()
        for k in range(0, len(words), 8):
            window = (" " + " ".join(words[k : k + 8])).encode() + b"\n" * 12
            gains.append(max(0, len(made[0].compress(window)) - len(made[1].compress(window)) - 1))
        n = len(gains)
        assert toxicity.features(t.encode(), made) == pytest.approx((sum(gains) / n, sum(g > 0 for g in gains) / n, math.log1p(sum(gains)), max(gains)))
    assert model.toxic.startswith(model.ordinary) and b" nastything" in model.toxic


def test_votes_are_those_of_brute_force():
    gen = np.random.default_rng(2)
    vectors = gen.standard_normal((60, 5)).astype(np.float32)
    vectors[10:40] = vectors[10]  # ties
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    model = quality.Model(np.ones(1), np.ones((1, 5)), vectors, (np.arange(60) % 3 == 0).astype(np.float32))
    asked = np.concatenate([vectors[8:12], gen.standard_normal((6, 5)).astype(np.float32), np.zeros((1, 5), np.float32)])
    cosines = asked @ vectors.T
    for row, got in zip(cosines[:-1], model.vote(asked)[:-1], strict=True):
        near = sorted(range(60), key=lambda k: (-row[k], k))[: quality.NEIGHBOURS]
        weights = [max(row[k], 1e-3) ** quality.SHARPNESS for k in near]
        assert got == pytest.approx(sum(w * model.labels[k] for w, k in zip(weights, near, strict=True)) / sum(weights), rel=1e-5)
    assert model.vote(asked)[-1] == pytest.approx(model.labels.mean())
