"""Base spans against the rules in Python, and what the trees add to them."""

import hashlib
import random
import re
import time

import numpy as np

from prismlake.llm import pii

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def card(rng):
    digits = "".join(rng.choice("0123456789") for _ in range(15))
    return next(digits + d for d in "0123456789" if luhn(digits + d))


def test_base_spans_are_those_of_the_rules(spark):
    rng, rows = random.Random(7), []
    pieces = ["a.b@c.de", "@", "x@y", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "12", " ", "-", "+1 (98) 555-24", "+", "é", "😀", "\n", "0", "a", "@d-e.f", "1-", "(", ")"]
    for k in range(400):
        rows.append((k % 300, "".join(rng.choice(pieces) for _ in range(rng.randrange(40))), k))
    rows += [(None, "write to q@r.st", 0), (900, None, 0), (900, "", 0)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, row long").withColumnRenamed("row", "key")).collect()
    want = sorted((str(i), hashlib.sha256(",".join(base(t or "")).encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    assert all(r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added == len([x for x in r.spans.split(",") if x]) for r in got)
    for r in got:
        spans = sorted(tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x)
        assert spans == [] or spans[0][0] >= 0


def planted():
    rng, rows = random.Random(3), []
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    for k in range(2400):
        kind = k % 4
        span = [f"{name()}@{name()}.com", ".".join(str(rng.randrange(10, 250)) for _ in range(4)), card(rng), f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"][kind]
        rows.append((k, f"{['mail', 'host', 'card', 'call'][kind]} {span} now", False))
    hidden = {9000: "mail john (at) corp (dot) com now", 9001: "mail mary at firm dot com now", 9002: "host 110[.]120[.]130[.]140 now", 9003: "host 110 dot 120 dot 130 dot 140 now", 9004: "call (988) 555-2485 now", 9005: f"card {card(rng)[:-1]}x now".replace("x", ""), 9006: "mail ME@corp. at noon", 9007: "MAIL JOHN [AT] CORP [DOT] COM now"}
    slip = card(rng)
    hidden[9005] = f"card {slip[:-1]}{(int(slip[-1]) + 1) % 10} now"
    rows += [(i, t, True) for i, t in hidden.items()]
    rows += [(5000 + k, f"we met at noon. Then at {name()} we left, page {k} of 2 at last.", False) for k in range(200)]
    return rows


def test_hidden_spans_of_every_kind_are_added(spark):
    rows = planted()
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    found = {i: got[i].spans.split(":")[0] for i in range(9000, 9008)}
    assert [found[i] for i in (9000, 9001, 9002, 9003, 9004, 9005, 9007)] == ["email", "email", "ip", "ip", "phone", "card", "email"]
    false = [i for i in got if not 9000 <= i < 9010 and (got[i].n_added or i >= 5000 and got[i].spans)]
    assert len(false) <= 0.01 * len(rows)  # precision: of some eight added spans none is of a clean text


def test_many_matches_take_linear_time(spark):
    texts = [(k, " ".join(f"u{i}@host{i % 9}.com" for i in range(n)) + " " + "j (at) c (dot) com, " * n) for k, n in enumerate((10, 5000, 20000))]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(1).cache()
    pii.personal_data(d.where("doc_id = 0")).collect()
    took = []
    for k in (1, 2):
        began = time.perf_counter()
        r = pii.personal_data(d.where(f"doc_id = {k}")).collect()[0]
        took.append(time.perf_counter() - began)
        assert r.n_email == (5000, 20000)[k - 1]
    assert took[1] < 12 * max(took[0], 1)


def test_cuts():
    score, p, n = np.array([3.0, 2.0, 2.0, 1.0, 0.0]), np.array([5, 5, 4, 0, 9]), np.array([5, 5, 5, 5, 9])
    assert pii.calibrated(score, p, n, 0.9) == 2.0 and pii.calibrated(score, p, n, 0.7) == 0.0 and pii.calibrated(score, p * 0, n, 0.5) == pii.NEVER
