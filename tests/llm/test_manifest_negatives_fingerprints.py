"""Merkle manifest, hard negatives and SimHash fingerprints against brute force, on tables with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from prismlake.llm import merkle, negatives, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, pos long, n long, print string, changed string, part int, links long"
CLASH = ("t", "d", 5, 6, "p", "c", 7, 8)


def table(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(5), []
    for k in range(60):
        text = " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "épsilon", "zeta"]) + str(rng.randrange(30)) for _ in range(rng.choice([0, 1, 2, 9, 60])))
        out.append((k, text, rng.choice(["en", "en", "de", "", None]), rng.choice(["web", None]), rng.choice([len(text), None])))
    out += [(70, "😀 long " * 20_000, "fr", "b", 9), (71, None, "en", None, 2**63 - 1), (None, "nameless", "en", "s", 3), (3, "again", "en", "s", 3), (3, "again", "en", "s", 3), (-5, "  \n", None, "s", 0)]
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r, more=0):
    n = r[4] if r[4] is None or r[4] + more < 2**63 else None
    return sha("".join(map(field, (r[0], r[3], r[2], None if n is None else n + more, r[1]))))


def reduce_(nodes, fan):
    """The root, and for each node its siblings on the way up, with its place among them."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, way in enumerate(ways):
            run, slot = at[k] // fan * fan, at[k] % fan
            way.append((slot, nodes[run : run + slot] + nodes[run + slot + 1 : run + fan]))
            at[k] //= fan
        nodes = [sha("".join(nodes[k : k + fan])) for k in range(0, len(nodes), fan)]
    return nodes[0], ways


@pytest.mark.parametrize(("fan", "chunk"), [(2, 1024), (2, 4), (3, 9), (5, 5)])
def test_manifest(spark, rows, monkeypatch, fan, chunk):
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    got = merkle.manifest(table(spark, rows), merkle.tampered(), fan).collect()
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for lang in langs:
        own = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[lang] = own, *reduce_([leaf(r) for r in own], fan)
    root, tops = reduce_([subs[x][1] for x in langs], fan)
    want = []
    for lang, top in zip(langs, tops, strict=True):
        for r, way in zip(subs[lang][0], subs[lang][2], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            value = leaf(r, 1) if hit else leaf(r)
            for slot, others in way + top:
                value = sha("".join([*others[:slot], value, *others[slot:]]))
            want.append((r[0], leaf(r), subs[lang][1], root, sha("".join(x for _, others in way + top for x in others)), value, value == root))
            assert (value == root) == (not hit)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_manifest_of_one_and_of_none(spark, rows):
    one = merkle.manifest(table(spark, rows[:1])).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == leaf(rows[0]) and one.proof_sha256 == sha("") and one.verified
    assert merkle.manifest(table(spark, [])).count() == 0


def test_states_are_those_of_whole_hashes():
    nodes = [sha(str(k)).encode() for k in range(5)]
    p = merkle.Parent(nodes)
    for slot in range(5):
        other = sha("x").encode()
        assert p.resumed(slot, other).decode() == hashlib.sha256(b"".join([*nodes[:slot], other, *nodes[slot + 1 :]])).hexdigest()


def mined(rows, every=50):
    """Brute force over distinct rows that take part."""
    v = []
    for i, x, label in dict.fromkeys((i, tuple(x) if x is not None else None, label) for i, x, label in rows):
        if i is None or label is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * c) for c in x]))
    out = []
    for i, label, x in v:
        if i % every:
            continue
        scored = sorted((-sum(map(int.__mul__, x, y)), j, other) for j, other, y in v if j != i and len(x) == len(y))
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            hard = [(j, -t) for t, j, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, p, rank, j, -s, t) for rank, (j, t) in enumerate(hard, 1)]
    return sorted(out)


def vectors(n, seed, dim=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(10, dim))
    return [(k, (middle[k % 10] * 0.5 + rng.normal(size=dim) * 0.5).round(2).tolist(), int(k % 10) if k % 9 else int(rng.integers(10))) for k in range(n)]


@pytest.mark.parametrize("block", [4096, 37])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    rows = vectors(300, 1)
    rows += [(k + 1000, rows[k % 3][1], k % 4) for k in range(60)]  # ties
    rows += [(2000, rows[0][1], None), (2050, None, 1), (2100, [], 1), (2150, [math.nan] * 6, 1), (2200, [math.inf] * 6, 1), (None, rows[5][1], 3), (2250, [0.5, None, 0.5, 0.5, 0.5, 0.5], 2), (50, rows[50][1], rows[50][2]), (100, rows[3][1], 5), (2300, [0.25] * 3, 1), (2301, [0.5] * 3, 1), (2302, [0.25, 0.25, 0.5], 2)]
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, v string, dim int, part int").repartition(4)
    got = sorted(tuple(r) for r in negatives.hard_negatives(negatives.taking_part(d)).collect())
    assert got == mined(rows) and len(got) > 50
    assert negatives.hard_negatives(negatives.taking_part(d.limit(0))).count() == 0


def test_large_components_are_exact_and_too_large_ones_refused(spark):
    rows = [(50 * k, [2.0**19 + k / 3, -(2.0**18) * k, 1.0], k % 2) for k in range(12)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in negatives.hard_negatives(negatives.taking_part(d)).collect()) == mined(rows)
    big = spark.createDataFrame([(50, [1e15], 1), (51, [1e15], 1)], d.schema)
    with pytest.raises(Exception, match="64 bits"):
        negatives.hard_negatives(negatives.taking_part(big)).count()


@pytest.mark.parametrize("partitions", ["4", "1", "13"])
def test_fingerprints(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = simhash.fingerprinted(table(spark, rows)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    prints = {r.fingerprint: np.frombuffer(bytes.fromhex(r.fingerprint), np.uint8) for r in got}
    assert len(got) == len(rows)
    unique = {i: t or "" for i, t, *_ in rows if i != 3}
    order = sorted((i for i in unique if i is not None), reverse=True) + [None]
    of = {r.doc_id: r for r in got}
    for k, i in enumerate(order):
        mine, following = unique[i], order[(k + 1) % len(order)]
        r = of[i]
        assert r.n_chars == len(mine) and r.fingerprint == simhash.fingerprints([mine.encode()])[0].tobytes().hex()
        assert r.class_id == min(x.doc_id for x in got if x.fingerprint == r.fingerprint and x.doc_id is not None) if i is not None else True
        assert r.n_near == sum(0 < np.bitwise_count(p ^ prints[r.fingerprint]).sum() <= 6 for p in prints.values())
        if 3 in (i, following) or following == 2:  # documents of id 3 stand between
            continue
        other = simhash.edited(mine, unique[following])
        assert r.edited_sha256 == sha(other) and r.edited_fingerprint == simhash.fingerprints([other.encode()])[0].tobytes().hex()
        a, b, c = (np.frombuffer(bytes.fromhex(x), np.uint8) for x in (r.fingerprint, r.edited_fingerprint, of[following].fingerprint))
        assert r.near_edited == pytest.approx(simhash.likeness(a[None], b[None])[0]) and r.near_next == pytest.approx(simhash.likeness(a[None], c[None])[0])


def test_fingerprints_of_one_and_of_none(spark):
    one = simhash.fingerprinted(table(spark, [(1, "abcdefg", "en", "s", 1)])).first()
    assert one.edited_sha256 == sha("abcde" + "ab") and one.near_next == 1.0 and one.n_near == 0
    assert simhash.fingerprinted(table(spark, [])).count() == 0


@pytest.mark.parametrize(("block", "chance", "radius"), [(2048, 64, 6), (16, 64, 3), (16, 1e-12, 3), (50, 1e-12, 2)])
def test_block_tables_find_all_within_the_radius(spark, monkeypatch, block, chance, radius):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CHANCE", chance)
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 256, (40, 16), np.uint8)
    for _ in range(500):  # families whose members differ in a few bits
        x = np.unpackbits(prints[rng.integers(0, 5)])
        x[rng.integers(0, 128, rng.integers(1, radius + 1))] ^= 1
        prints = np.concatenate([prints, np.packbits(x)[None]])
    prints = np.unique(prints, axis=0)
    got = {bytes(r["print"]): r.n_near for r in simhash.near_counts(spark.createDataFrame([(p.tobytes(), 1) for p in prints], "print binary, links int").repartition(5), radius).collect()}
    for p in prints:
        n = np.bitwise_count(prints ^ p).sum(axis=1)
        assert got.get(p.tobytes(), 0) == int(((n > 0) & (n <= radius)).sum())


def test_each_pair_has_one_first_table():
    made = simhash.tables(1 << 60, 2)
    assert len(made) == 9
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = np.zeros(128, np.uint8)
        x[rng.choice(128, rng.integers(1, 3), replace=False)] = 1
        differ = np.packbits(x).view(np.uint64)
        first = [t for t, (front, places) in enumerate(made) if not (differ & simhash._mask(tuple(itertools.chain(*front)))).any() and all((differ & m).any() for m in simhash.earlier(front, places))]
        assert len(first) == 1
