"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of telling words and word beginnings is learnt from a bounded labelled sample, then trees over densities
and rates, then the map from their scores to probabilities. Spark counts words and computes features, numpy fits on
the few numbers per sampled document, and scoring runs over every whole text.
"""

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import materialised

# Insults that are toxic whatever the sample holds, and pronouns that address someone.
INSULTS = (
    "asshole bastard bitch bullshit clown crap cretin damn dickhead disgusting dumb dumbass filthy fool freak fuck fucking garbage "
    "hate idiot idiotic imbecile jerk kill loser moron moronic motherfucker pathetic pig retard scum shit slut stupid trash ugly "
    "vermin vile whore worthless"
).split()
SECOND_PERSON = (
    "you your yours yourself yourselves u ur thou thee thy du dich dir dein deine deinen deiner ihr euch euer "
    "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os vuestro"
).split()
#: Characters that stand for letters inside words.
DISGUISED = str.maketrans("013457@$!", "oieastasi")
BEGINNINGS = (4, 5, 6)
NEAR = 6
FEATURES = (
    "hit_share beginning_share weight_share strongest log_hits second_person_share near_share "
    "capital_share punctuation_share exclamation_share digit_share disguise_share disguised_hits log_words"
).split()


@dataclass(frozen=True)
class Training:
    """``max_toxic`` and ``max_clean`` bound the labelled documents the model learns from, taken by a hash."""

    max_toxic: int = 3000
    max_clean: int = 9000
    max_lexicon: int = 4000
    least_docs: int = 3
    least_odds: float = 2.0
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 48
    smoothing: float = 5.0


@dataclass
class Model:
    """Lexicon weights, trees as (feature, threshold, left, right, value) arrays, and the calibration's knots."""

    lexicon: dict[str, float]
    start: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    knots: tuple = (np.zeros(1), np.zeros(1))


class _Kinds(dict):
    """Kind of each word seen: 0 ordinary, 1 second person, 2 + i the lexicon's entry i, for words and beginnings."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.entries = {w: i for i, w in enumerate(lexicon)}
        self.weights = np.array([0.0, 0.0, *lexicon.values()])
        self.is_word = np.array([False, False, *[not w.endswith("*") for w in lexicon]])
        self.second = frozenset(SECOND_PERSON)

    def __missing__(self, word):
        keys = [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n]]
        found = [self.entries[k] + 2 for k in keys if k in self.entries]
        kind = max(found, key=lambda i: self.weights[i]) if found else int(word in self.second)
        if len(self) > 400_000:
            self.clear()
        self[word] = kind
        return kind


def _byte_classes() -> np.ndarray:
    """Bit 0 capital, 1 punctuation, 2 exclamation, 3 digit, 4 letter, 5 a letter's disguise."""
    t = np.zeros(256, dtype=np.uint8)
    t[65:91] = 1 | 16
    t[97:123] = 16
    t[128:] = 16
    t[48:58] = 8
    for c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
        t[c] |= 2
    t[ord("!")] |= 4
    t[ord("?")] |= 4
    for c in b"013457@$!*":
        t[c] |= 32
    return t


def features(texts: list[str], kinds: _Kinds) -> np.ndarray:
    """One row of ``FEATURES`` per text. Texts without words have zeros in all shares."""
    find, classes = regex.compile(r"[^\W\d_]+").findall, _byte_classes()
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = classes[np.frombuffer(text.encode("utf-8"), dtype=np.uint8)]
        letter, n = (raw & 16) > 0, len(raw)
        inner = (raw[1:-1] & 32 > 0) & letter[:-2] & letter[2:] if n > 2 else np.zeros(0, dtype=bool)
        disguises = int(np.count_nonzero(inner))
        words = find(text.lower())
        kind = np.fromiter(map(kinds.__getitem__, words), dtype=np.int64, count=len(words))
        hits = np.flatnonzero(kind > 1)
        total = max(len(words), 1)
        row = out[i]
        if len(hits):
            found = kind[hits]
            weights = kinds.weights[found]
            row[0] = np.count_nonzero(kinds.is_word[found]) / total
            row[1] = np.count_nonzero(~kinds.is_word[found]) / total
            row[2], row[3], row[4] = weights.sum() / total, weights.max(), math.log1p(len(hits))
        people = np.flatnonzero(kind == 1)
        row[5] = len(people) / total
        if len(hits) and len(people):
            after = np.searchsorted(people, hits)
            gap = np.minimum(np.abs(people[np.minimum(after, len(people) - 1)] - hits), np.abs(people[np.maximum(after - 1, 0)] - hits))
            row[6] = np.count_nonzero(gap <= NEAR) / total
        for j, bit in ((7, 1), (8, 2), (9, 4), (10, 8)):
            row[j] = np.count_nonzero(raw & bit) / n
        row[11] = disguises / total
        if disguises:
            plain = find(text.lower().translate(DISGUISED))
            row[12] = max(0, sum(kinds[w] > 1 for w in plain) - len(hits)) / total
        row[13] = math.log1p(len(words))
    return out


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, edges: list[np.ndarray], how: Training):
    """One tree on binned features: a heap of nodes split where the loss falls most."""
    size = 2 ** (how.depth + 1) - 1
    feature, bound, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    node = np.zeros(len(x), dtype=np.int64)
    gains = lambda g, h: g * g / (h + how.smoothing)
    for level in range(how.depth + 1):
        for at in range(2**level - 1, 2 ** (level + 1) - 1):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            g, h = grad[rows].sum(), hess[rows].sum()
            value[at] = how.rate * g / (h + how.smoothing)
            best = (1e-6, None, None)
            for j in range(x.shape[1]) if level < how.depth else ():
                if not len(edges[j]):
                    continue
                left_g = np.cumsum(np.bincount(x[rows, j], weights=grad[rows], minlength=len(edges[j]) + 1))[:-1]
                left_h = np.cumsum(np.bincount(x[rows, j], weights=hess[rows], minlength=len(edges[j]) + 1))[:-1]
                gain = gains(left_g, left_h) + gains(g - left_g, h - left_h) - gains(g, h)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] is not None:
                feature[at], bound[at] = best[1], edges[best[1]][best[2]]
                node[rows] = 2 * at + 1 + (x[rows, best[1]] > best[2])
    return feature, bound, value


def _tree_values(tree, x: np.ndarray) -> np.ndarray:
    feature, bound, value = tree
    node = np.zeros(len(x), dtype=np.int64)
    while True:
        inner = np.flatnonzero(feature[node] >= 0)
        if not len(inner):
            return value[node]
        at = node[inner]
        node[inner] = 2 * at + 1 + (x[inner, feature[at]] > bound[at])


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, how: Training) -> tuple[float, list[tuple]]:
    """Logistic boosting: a start value and trees over raw features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, how.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    # A feature that is 0 nearly everywhere still splits at 0.
    edges = [np.unique(np.append(e, 0.0)) if len(x) and x[:, j].min() <= 0 < x[:, j].max() else e for j, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros(x.shape, dtype=np.int64)
    mean = min(max(float((y * weight).sum() / max(weight.sum(), 1e-9)), 1e-4), 1 - 1e-4)
    start = math.log(mean / (1 - mean))
    score, trees = np.full(len(x), start), []
    if len(x) and y.min() < y.max():
        for _ in range(how.trees):
            p = 1 / (1 + np.exp(-score))
            tree = _grow(binned, weight * (y - p), weight * p * (1 - p), edges, how)
            trees.append(tree)
            score += _tree_values(tree, x)
    return start, trees


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising map from scores to probabilities: pooled blocks, joined by lines so that order survives."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean score, mean label, weight
    for s, t, w in zip(score[order], y[order], weight[order]):
        blocks.append([float(s), float(t), float(w)])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][0] >= blocks[-1][0]):
            s2, t2, w2 = blocks.pop()
            b = blocks[-1]
            b[0], b[1] = (b[0] * b[2] + s2 * w2) / (b[2] + w2), (b[1] * b[2] + t2 * w2) / (b[2] + w2)
            b[2] += w2
    if not blocks:
        return np.zeros(1), np.zeros(1)
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def raw_scores(model: Model, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model.start)
    for tree in model.trees:
        out += _tree_values(tree, x)
    return out


def calibrated(model: Model, raw: np.ndarray) -> np.ndarray:
    """Probabilities; a hundredth is left to the raw score's own, so that ties on a plateau keep their order."""
    return np.clip(0.99 * np.interp(raw, *model.knots) + 0.01 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)


def _lexicon(texts: DataFrame, how: Training) -> dict[str, float]:
    """Words and beginnings that toxic documents hold far more often, with their log odds. At most ``max_lexicon``."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    keys = F.flatten(
        F.transform(words, lambda w: F.array_compact(F.array(w, *[F.when(F.length(w) > n, F.concat(F.substring(w, F.lit(1), F.lit(n)), F.lit("*"))) for n in BEGINNINGS])))
    )
    counts = texts.select("toxic", F.explode(F.array_distinct(keys)).alias("key")).groupBy("key").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    t_all, c_all = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    odds = F.log((F.col("t") + 0.5) / (t_all + 1.0)) - F.log((F.col("c") + 0.5) / (c_all + 1.0))
    rows = counts.where(F.col("t") >= how.least_docs).select("key", odds.alias("odds"), "t").where(F.col("odds") >= how.least_odds)
    rows = rows.orderBy(F.desc(F.col("odds") * F.log("t")), "key").limit(how.max_lexicon).collect()
    lexicon = {w: 6.0 for w in INSULTS}
    lexicon.update({r["key"]: float(r["odds"]) for r in rows})
    return lexicon


def _features_udf(lexicon: dict[str, float]):
    state = {}

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        if not state:
            state["kinds"] = _Kinds(lexicon)
        return pa.array(list(features([t.as_py() for t in texts], state["kinds"])), type=pa.list_(pa.float64()))

    return run


def fit(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """Learn from ``doc_id, text`` and ``doc_id, toxic`` (0 or 1; other rows are left out, of several the largest counts).

    Of each class at most ``max_toxic`` and ``max_clean`` labelled ids, the first by a hash, are used; each then
    weighs as many as it stands for. Each half of them is given the features that a lexicon of the other half finds,
    so that trees do not learn from words a document itself brought in; four fifths of them then give the trees and
    a fifth the calibration. Scoring uses the lexicon of all. Of rows that share an id, one is used.
    """
    rows = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    slim = rows.withColumn("turn", F.xxhash64("doc_id"))
    n = {r["toxic"]: r["count"] for r in slim.groupBy("toxic").count().collect()}
    chosen = None
    for label, most in ((1, how.max_toxic), (0, how.max_clean)):
        part = slim.where(F.col("toxic") == label).orderBy("turn", "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # The bound of the sample bounds this table; the texts of the other documents are not moved.
    picked = docs.select("doc_id", "text").join(F.broadcast(materialised(chosen)), "doc_id")
    sample = picked.groupBy("doc_id", "toxic", "turn").agg(F.min("text").alias("text"))
    sample = materialised(sample.withColumn("part", F.pmod(F.xxhash64("turn"), F.lit(10))))
    lexicon, rest = _lexicon(sample, how), []
    for half in (0, 1):
        other = _features_udf(_lexicon(sample.where(F.col("part") % 2 != half), how))
        own = sample.where(F.col("part") % 2 == half)
        rest += own.select("toxic", "part", "turn", other(F.coalesce("text", F.lit(""))).alias("x")).orderBy("turn").collect()
    x = np.array([r["x"] for r in rest]).reshape(len(rest), len(FEATURES))
    y, part = np.array([r["toxic"] for r in rest], dtype=float), np.array([r["part"] for r in rest])
    weight = np.where(y == 1, max(1.0, n.get(1, 0) / how.max_toxic), max(1.0, n.get(0, 0) / how.max_clean))
    trees, last = part < 8, part >= 8
    start, grown = boost(x[trees], y[trees], weight[trees], how)
    model = Model(lexicon, start, grown)
    held = last if last.any() and y[last].min(initial=1) < y[last].max(initial=0) else np.ones(len(y), dtype=bool)
    if held.any():
        model.knots = isotonic(raw_scores(model, x[held]), y[held], weight[held])
    return model


def score(model: Model, text: Column) -> Column:
    """Probability that a text is toxic; null and empty texts get that of a text without features."""
    state = {}

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        if not state:
            state["kinds"] = _Kinds(model.lexicon)
        out = []
        for at in range(0, len(texts), 512):
            x = features([t.as_py() for t in texts[at : at + 512]], state["kinds"])
            out.append(calibrated(model, raw_scores(model, x)))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return run(F.coalesce(text, F.lit("")))
