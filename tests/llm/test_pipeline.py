import collections
import hashlib
import random
from pathlib import Path

import corpus_pipeline
from prismlake.llm import decontaminate, labelled, mixing, toxicity
from prismlake.session import shared_dir

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.columns == ["doc_id", "size", "source_size", "target", "taken"] and docs.count() <= before


def corpus():
    rng, words, rows, labels = random.Random(9), [f"w{k}" for k in range(900)], [], []
    bench = [(f"q{k}", " ".join(rng.choice(words) for _ in range(20))) for k in range(3)]
    for k in range(160):
        text = [rng.choice(words) for _ in range(rng.choice([30, 60, 90]))]
        if k % 4 == 0:
            for _ in range(8):
                text[rng.randrange(len(text))] = rng.choice(["vileword", "nastything"])
        labels.append((k, 1, int(k % 4 == 0)))
        rows.append((k, " ".join(text), "en", rng.choice(["a", "b", None]), 0))
    for k in range(160, 180):  # exact and near copies, and contaminated documents
        text = rows[rng.randrange(1, 40) * 4 + 1][1].split()
        if k % 3 == 1:
            text[rng.randrange(len(text))] = "changed"
        if k % 3 == 2:
            text = [rng.choice(words) for _ in range(30)] + bench[k % 3 - 1][1].split()[2:18]
        rows.append((k, " ".join(text).upper() if k % 2 else " ".join(text), "en", "a", 0))
    return [*rows, (180, None, None, None, None), (181, "", "en", "b", 0)], labels, bench


def test_rows_are_those_of_brute_force(spark, tmp_path):
    rows, labels, bench = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # toxicity: the model is fitted on the training fold of the labels
    table = spark.read.parquet(str(tmp_path / "labels.parquet"))
    fold = {r.doc_id: r.y for r in labelled.training_labels(table, "toxic").collect()}
    model = toxicity.fit([(fold[r[0]], (r[1] or "").encode()) for r in rows if r[0] in fold])
    compressors = model.compressors()
    clean = [r for r in rows if sum(a * b for a, b in zip(model.weights, (1.0, *toxicity.features((r[1] or "").encode(), compressors)), strict=True)) < 0]
    assert {r[0] for r in rows[:160]} - {r[0] for r in clean} == set(range(0, 160, 4))
    # exact copies
    last = {}
    for r in clean:
        last[hashlib.sha256((r[1] or "").lower().encode()).digest()] = r
    # near copies
    left = sorted(last.values())
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((r[1] or "").lower().split() for r in left)]
    up = list(range(len(left)))
    for b in range(len(left)):
        for a in range(b):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and up[a] != up[b]:
                low, high = sorted((up[a], up[b]))
                up = [low if u == high else u for u in up]
    firsts = [r for k, r in enumerate(left) if up[k] == k]
    assert len(firsts) < len(left) < len(clean)
    # contamination
    grams = {tuple(w[k : k + 13]) for _, t in bench for w in [t.split()] for k in range(len(w) - 12)}
    kept = []
    for r in firsts:
        w, hit = decontaminate.WORD.findall((r[1] or "").lower()), set()
        for k in range(len(w) - 12):
            if tuple(w[k : k + 13]) in grams:
                hit |= set(range(k, k + 13))
        if not hit or 20 * len(hit) < len(w):
            kept.append(r)
    assert len(kept) < len(firsts)
    # mixing
    by = collections.defaultdict(list)
    for r in kept:
        by[r[3]].append((hashlib.md5(f"7:{r[0]}".encode()).hexdigest(), r[0], len((r[1] or "").split())))
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    total, target, free = 1.5 * sum(x[2] for v in by.values() for x in v), {}, set(sources)
    while free:
        level = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * sum(x[2] for x in by[s])}
        target |= {s: 2.0 * sum(x[2] for x in by[s]) for s in over} if over else {s: level * weights[s] for s in free}
        free = free - over if over else set()
    want = {}
    for s in sources:
        size = sum(x[2] for x in by[s])
        epochs = round(target[s]) // size
        rest = round(target[s]) - epochs * size
        for _, i, n in sorted(by[s]):
            taken = epochs * n + max(0, min(n, rest))
            rest -= n
            if taken:
                want[i] = (n, size, taken)
    assert {i: (r[1], r[2], r[4]) for i, r in got.items()} == want
    assert mixing.ORACLE and all(abs(r[3] - target[{x[0]: x[3] for x in kept}[i]]) < 1e-6 for i, r in got.items())


def test_empty_tables(spark, tmp_path):
    rows, labels, bench = corpus()
    for name, data, schema in (("documents", [], SCHEMA), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [], "item_id string, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    left = {p.name for p in folder.iterdir()} - before
    assert len(left) == 1 and left.pop().startswith("pipeline-mixing-")
    some = spark.createDataFrame([(1, "a b c", "en", None, 0), (None, None, None, None, None)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, some, str(tmp_path)).count() == 2
