"""Personal data: candidate spans scored by gradient-boosted trees, with DataFrame operations only.

High-recall generators propose spans, which may overlap. Spans that the strict rules accept always
stay. All others are scored by boosted trees over features of format, taken after undoing what hides an
address, and of context. The trees learn from counts of feature vectors over four folds of all
documents what accepted spans look like; in the fifth fold, which they have not seen, each kind's cut is
calibrated: the least score from which on candidates are accepted ones by a target share.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
# (kind, pattern, what a text must hold some of, in lower case). The strict ones come first, one for each kind. Lookbehinds
# let a match start only where the leftmost one must, so that no text makes the search quadratic; \G
# is the end of the match before.
STRICT = (
    ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+", ""),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+"),
)
LOOSE = (
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}| at |@) ?[a-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[a-z0-9-]{2,63}+){1,4}+", "@", "at"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\[\.\]|\(\.\)| dot )[0-9]{1,3}(?:\[\.\]|\(\.\)|\.| dot )[0-9]{1,3}(?:\[\.\]|\(\.\)|\.| dot )[0-9]{1,3}(?![0-9])", ".", " dot "),
    ("ip", r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])", ":"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ ./_-]?[0-9]{4}){2}[ ./_-]?[0-9]{1,7}(?![0-9])", ""),
    ("phone", r"(?<![0-9+])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])", ""),
)
#: Folded words before a span that speak for a kind.
CONTEXT = {1: "e-?mail|contact|write to|mailto", 2: "phone|tel|call|mobile|fax|whatsapp", 3: "card|visa|credit|amex|master", 4: r"\bip\b|host|server|addr|login from"}
#: The bins of each feature, in the order of the feature vector: at most 115,200 vectors.
BINS = {"kind": 4, "digits": 8, "parts": 5, "marks": 4, "words": 5, "before": 3, "after": 3, "tail": 4}
FEATURES = tuple(BINS)
#: One fold of so many is held out from the trees, and calibrates the cuts: of candidates above a cut this share is accepted by the strict rules.
FOLDS, TARGET = 5, 0.9
#: Code points to a bucket in which spans that overlap meet.
BUCKET = 64


def _hits(text: str, pattern: str, *needs: str) -> Column:
    """All leftmost non-overlapping matches."""
    guard = F.lit(True)
    if any(needs):
        low = F.lower(F.col(text)) if any(n.lower() != n.upper() for n in needs) else F.col(text)
        guard = F.contains(low, F.lit(needs[0])) if len(needs) == 1 else F.contains(low, F.lit(needs[0])) | F.contains(low, F.lit(needs[1]))
    return F.when(guard, F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))


def _placed(h: str, p: str) -> str:
    """Structs of start, end (code points), match, folded text before and character behind.

    Running sums of lengths go by blocks of about the square root of their number, and what stands
    around a match comes from its neighbours: no match costs a walk through the whole text.
    """
    sums = "aggregate(slice(v.lens, (b - 1) * v.w + 1, v.w), 0, (x, y) -> x + y)"
    return f"""CASE WHEN size({h}) = 0 THEN array() ELSE
      transform(array(named_struct('lens', transform({h}, (x, i) -> length({p}[i]) + length(x)), 'w', cast(ceil(sqrt(size({h}))) AS int))), v ->
        transform(array(aggregate(sequence(1, cast(ceil(size(v.lens) / v.w) AS int)), named_struct('at', 0, 'out', array(0)), (a, b) -> named_struct('at', a.at + {sums}, 'out', concat(a.out, array(a.at + {sums}))), a -> a.out)), off ->
          transform(transform({h}, (x, i) -> named_struct('m', x,
              's', off[cast(i div v.w AS int)] + aggregate(slice(v.lens, cast(i div v.w AS int) * v.w + 1, i % v.w), 0, (x, y) -> x + y) + length({p}[i]),
              'l', lower(right(concat(CASE WHEN i > 0 THEN {h}[i - 1] ELSE '' END, {p}[i]), 24)),
              'r', left(concat({p}[i + 1], coalesce(get({h}, i + 1), '')), 1))),
            x -> named_struct('s', x.s, 'e', x.s + length(x.m), 'm', x.m, 'l', x.l, 'r', x.r)))[0])[0] END"""


CHECKS = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)",
    "card": """length(regexp_replace(x.m, '[ -]', '')) BETWEEN 12 AND 19 AND aggregate(sequence(1, length(regexp_replace(x.m, '[ -]', ''))), 0, (a, i) -> a +
       CASE WHEN i % 2 = 1 THEN cast(substring(regexp_replace(x.m, '[ -]', ''), -i, 1) AS int)
            ELSE 2 * cast(substring(regexp_replace(x.m, '[ -]', ''), -i, 1) AS int) - CASE WHEN substring(regexp_replace(x.m, '[ -]', ''), -i, 1) > '4' THEN 9 ELSE 0 END END) % 10 = 0""",
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 9 AND 15",
}


def candidates(docs: DataFrame) -> DataFrame:
    """row, key (of id and text), doc_id and an array of candidates: s, e, strict, kind and the bins of the other features."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    every = [(*x, True) for x in STRICT] + [(*x, False) for x in LOOSE]
    rows = rows.select("*", *(_hits("t", p, *needs).alias(f"h{k}") for k, (_, p, *needs, _) in enumerate(every)))
    # few texts have matches: only those are split to learn where the matches are
    rows = rows.select("*", *(F.when(F.size(f"h{k}") > 0, F.split("t", p, -1)).alias(f"p{k}") for k, (_, p, *_) in enumerate(every)))
    lists = []
    for k, (kind, *_, strict) in enumerate(every):
        passes = CHECKS[kind] if strict else "false"
        lists.append(f"transform({_placed(f'h{k}', f'p{k}')}, x -> named_struct('s', x.s, 'e', x.e, 'm', x.m, 'kind', {KINDS.index(kind)}, 'strict', {passes}, 'loose', {str(not strict).lower()}, 'l', x.l, 'r', x.r))")
    # what fails its strict rule is no address and no number; a card with a slip in it may still be one
    rows = rows.select("doc_id", "t", F.expr(f"filter(concat({', '.join(lists)}), x -> x.strict OR x.loose OR x.kind = {KINDS.index('card')})").alias("c"))
    # what hides an address is undone: brackets always, bare words where both stand in the span
    bare = "CASE WHEN lower(x.m) LIKE '% dot %' THEN replace(replace(lower(x.m), ' at ', '@'), ' dot ', '.') ELSE lower(x.m) END"
    clean = rf"regexp_replace(regexp_replace({bare}, ' ?[(\\[{{]at[)\\]}}] ?', '@'), ' ?([(\\[{{]dot[)\\]}}]|[(\\[][.][)\\]]) ?', '.')"
    rows = rows.select("doc_id", "t", F.expr(f"transform(c, x -> named_struct('s', x.s, 'e', x.e, 'strict', x.strict, 'kind', x.kind, 'l', x.l, 'r', x.r, 'm', {clean}))").alias("c"))
    side = lambda c: f"CASE WHEN {c} = '' OR {c} RLIKE '\\\\s' THEN 0 WHEN {c} RLIKE '\\\\w' THEN 1 ELSE 2 END"
    bins = {
        "digits": "least(7, cast(length(regexp_replace(x.m, '[^0-9]', '')) / 3 AS int))",
        "parts": "least(4, size(split(x.m, '[.]')) - 1)",
        "marks": "least(3, length(regexp_replace(x.m, '[^ ()/_]', '')))",
        "words": "CASE " + " ".join(f"WHEN x.l RLIKE '{p}' THEN {k}" for k, p in ((k, p.replace("\\", "\\\\")) for k, p in CONTEXT.items())) + " ELSE 0 END",
        "before": side("right(x.l, 1)"),
        "after": side("x.r"),
        "tail": "least(3, length(regexp_extract(x.m, '[.]([a-z]+)$', 1)))",
    }
    fields = ", ".join(f"'{k}', cast({v} AS int)" for k, v in bins.items())
    spans = F.expr(f"transform(c, x -> named_struct('s', x.s, 'e', x.e, 'strict', x.strict, 'kind', x.kind, {fields}))")
    return rows.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id", "t").alias("key"), "doc_id", spans.alias("c"))


@dataclass
class Node:
    """value where feature is None; otherwise left where the feature is at most cut."""

    value: float = 0.0
    feature: str | None = None
    cut: int = 0
    left: Node | None = None
    right: Node | None = None

    def sql(self, x: str) -> str:
        return f"{self.value!r}D" if self.feature is None else f"CASE WHEN {x}.{self.feature} <= {self.cut} THEN {self.left.sql(x)} ELSE {self.right.sql(x)} END"

    def of(self, x: np.ndarray) -> np.ndarray:
        """Of vectors, a row each."""
        if self.feature is None:
            return np.full(len(x), self.value)
        return np.where(x[:, FEATURES.index(self.feature)] <= self.cut, self.left.of(x), self.right.of(x))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float = 1.0) -> Node:
    """Of vectors with gradients and curvatures: a regression tree by second-order gain."""
    all_g, all_h, best = g.sum(), h.sum(), (1e-6, None, 0)
    for k, f in enumerate(FEATURES if depth else ()):
        low_g, low_h = np.cumsum(np.bincount(x[:, k], g, BINS[f]))[:-1], np.cumsum(np.bincount(x[:, k], h, BINS[f]))[:-1]
        gain = low_g**2 / (low_h + ridge) + (all_g - low_g) ** 2 / (all_h - low_h + ridge) - all_g**2 / (all_h + ridge)
        gain[(low_h <= 0) | (all_h - low_h <= 1e-9)] = 0
        if (at := int(gain.argmax())) is not None and gain[at] > best[0]:
            best = (gain[at], f, at)
    if best[1] is None:
        return Node(rate * float(all_g / (all_h + ridge)))
    left = x[:, FEATURES.index(best[1])] <= best[2]
    return Node(0.0, best[1], best[2], *(_grow(x[side], g[side], h[side], depth - 1, rate, ridge) for side in (left, ~left)))


@dataclass
class Model:
    start: float
    trees: list[Node]
    cuts: tuple[float, ...]  # of each kind, in log odds

    def sql(self, x: str) -> str:
        return " + ".join([f"{self.start!r}D", *(f"({t.sql(x)})" for t in self.trees)])

    def cut(self, x: str) -> str:
        return "CASE " + " ".join(f"WHEN {x}.kind = {k} THEN {v!r}D" for k, v in enumerate(self.cuts)) + " END"

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:  # in the order of the SQL, so that sums are equal to the last bit
            out += t.of(x)
        return out


#: A cut that nothing reaches.
NEVER = 1e9


def calibrated(score: np.ndarray, accepted: np.ndarray, total: np.ndarray, target: float) -> float:
    """The least score from which on the accepted ones are at least the target share of all."""
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(accepted[order]) / np.cumsum(total[order])
    last = np.append(np.diff(score[order]) != 0, True)  # equal scores fall on one side
    good = np.flatnonzero(last & (share >= target) & (np.cumsum(accepted[order]) > 0))
    return float(score[order][good[-1]]) if len(good) else NEVER


def boost(x: np.ndarray, accepted: np.ndarray, total: np.ndarray, held: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3, target: float = TARGET) -> Model:
    """Vectors with the numbers of accepted and of all spans that have them; held vectors calibrate, the others train."""
    tx, p, n = x[~held], accepted[~held], total[~held]
    if not n.sum():
        return Model(0.0, [], (NEVER,) * len(KINDS))
    start = math.log((p.sum() + 0.5) / (n.sum() - p.sum() + 0.5))
    raw, trees = np.full(len(tx), start), []
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-raw))
        trees.append(_grow(tx, p - n * chance, n * chance * (1 - chance), depth, rate))
        raw += trees[-1].of(tx)
    model = Model(start, trees, ())
    score, cuts = model.of(x), []
    for k in range(len(KINDS)):
        own = held & (x[:, 0] == k)
        cuts.append(calibrated(score[own], accepted[own], total[own], target) if own.any() else NEVER)
    return Model(start, trees, tuple(cuts))


def _buckets(spans: DataFrame) -> DataFrame:
    return spans.withColumn("bucket", F.explode(F.sequence(F.expr(f"s div {BUCKET}"), F.expr(f"(e - 1) div {BUCKET}"))))


AT = ("row", "s", "e", "kind")


def visible(found: DataFrame) -> DataFrame:
    """A row for each candidate: the strict ones, and of the others those that overlap no strict one."""
    spans = found.select("row", "doc_id", F.explode("c").alias("x")).select("row", "doc_id", "x.*").distinct()
    strict, loose = spans.where("strict"), spans.where("NOT strict")
    near = _buckets(loose.select(*AT)).join(_buckets(strict.select("row", "s", "e")).toDF("row", "ys", "ye", "bucket"), ["row", "bucket"])
    return strict.unionByName(loose.join(near.where("s < ye AND ys < e").select(*AT).distinct(), list(AT), "left_anti"))


def learn(spans: DataFrame, target: float = TARGET) -> Model:
    """From counts of feature vectors, whose number the bins bound; the counts cover all candidates of all documents."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0
    rows = spans.groupBy(held.alias("held"), *FEATURES).agg(F.count_if("strict").alias("p"), F.count("*").alias("n")).collect()
    rows = sorted(tuple(r) for r in rows)
    table = np.array(rows, float).reshape(len(rows), len(FEATURES) + 3)
    return boost(table[:, 1:-2].astype(int), table[:, -2], table[:, -1], table[:, 0] > 0, target=target)


def added(spans: DataFrame, model: Model) -> DataFrame:
    """row, s, e, kind of the candidates beside the strict spans that stay."""
    x = F.struct(*FEATURES).alias("x")
    chosen = spans.where("NOT strict").select(*AT, x).select(*AT, F.expr(model.sql("x")).alias("score"), F.expr(model.cut("x")).alias("cut")).where("score >= cut").drop("cut")
    better = "yscore > score OR (yscore = score AND (ye - ys > e - s OR (ye - ys = e - s AND (ys < s OR (ys = s AND ykind < kind)))))"
    rival = _buckets(chosen).toDF("row", "ys", "ye", "ykind", "yscore", "bucket")
    beaten = _buckets(chosen).join(rival, ["row", "bucket"]).where("s < ye AND ys < e").where(better).select(*AT)
    return chosen.select(*AT).join(beaten.distinct(), list(AT), "left_anti")


def _found(docs: DataFrame, target: float) -> DataFrame:
    found = materialize(candidates(docs), "spans")
    spans = materialize(visible(found), "visible")
    more = added(spans, learn(spans, target))
    spans = spans.where("strict").select(*AT, "strict").unionByName(more.withColumn("strict", F.lit(False)))
    names = ", ".join(f"'{k}'" for k in KINDS)
    line = lambda c: f"array_join(transform(array_sort({c}), x -> concat(array({names})[x.kind], ':', x.s, ':', x.e)), ',')"
    span = F.struct("s", "kind", "e")
    by_row = spans.groupBy(F.col("row").alias("of")).agg(
        *(F.count_if(F.col("strict") & (F.col("kind") == k)).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.collect_list(F.when(F.col("strict"), span)).alias("base"),
        F.collect_list(span).alias("spans"),
        F.count_if(~F.col("strict")).alias("n_added"),
    )
    by_row = by_row.select("of", *(f"n_{name}" for name in KINDS), F.expr(line("base")).alias("base"), F.expr(line("spans")).alias("spans"), "n_added")
    out = found.select("row", "key", "doc_id").join(by_row, F.col("row") == F.col("of"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("key", "doc_id", *(zero(f"n_{name}") for name in KINDS), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_added"))


def personal_data(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """doc_id, the numbers n_email, n_ip, n_card, n_phone of strict spans, base_sha256 of these, spans (all), n_added.

    A candidate beside the strict spans is added when its score reaches its kind's cut, no strict span
    overlaps it, and no candidate that is better (by score, then length, then the earlier) does; a kind
    of which the held-out fold has no accepted span adds none. Null and empty texts have no spans. Texts
    of any length count whole. Repeated rows give one row each; other columns are ignored. An empty
    table gives an empty result.
    """
    return _found(docs, target).drop("key")


def redact(docs: DataFrame, target: float = TARGET, mask: str = "[{kind}]") -> DataFrame:
    """doc_id and the text with every span of personal_data() masked; of overlapping spans the first hides the rest."""
    spans = _found(docs, target).select(F.col("key").alias("span_key"), F.expr("transform(filter(split(spans, ','), x -> x != ''), x -> named_struct('kind', split(x, ':')[0], 's', int(split(x, ':')[1]), 'e', int(split(x, ':')[2])))").alias("x")).distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = text.withColumn("key", F.xxhash64("doc_id", "text")).join(spans, F.col("key") == F.col("span_key"))
    a, b = mask.split("{kind}")
    return text.select("doc_id", F.expr(f"aggregate(x, named_struct('at', 0, 'out', ''), (a, y) -> CASE WHEN y.e <= a.at THEN a ELSE named_struct('at', y.e, 'out', concat(a.out, substring(text, a.at + 1, greatest(0, y.s - a.at)), '{a}', y.kind, '{b}')) END, a -> concat(a.out, substring(text, a.at + 1)))").alias("text"))
