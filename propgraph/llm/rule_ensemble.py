"""Quality classifier: a sparse ensemble of conjunctive rules, compiled into column expressions.

Statistics of each text come from SQL functions. Boosted trees are grown on a bounded sample of
labelled rows; every path from a root to a node is a rule, a conjunction of bounds on statistics.
A lasso logistic regression over the rules keeps few of them, and the score is one Spark expression:
the logistic of the kept rules' weights. Scoring therefore runs no Python.

The fit sees at most ``SAMPLE`` labelled rows (those of least crc32 of the id), as a table of
numbers. Null and empty texts have all statistics 0 and are scored like others. Without labels of
both classes every score is the share of good labels, or 0.5 without labels. Rows of a repeated id
are rows of their own in the fit and score alike; labels with a null id or value are not used; very
long texts are read whole. An empty table gives no rows. Only the id and text columns are looked at, so
names of others do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, held_out, words
from .quality_rules import STOP_WORDS, SYMBOLS

SAMPLE = 20_000
FOLDS, FOLD = 4, 2
TREES, DEPTH, BINS, LEAST = 24, 3, 48, 5
RATE = 0.3
PENALTY = 5e-4

STATISTICS = (
    "n_words",
    "mean_word_chars",
    "symbol_ratio",
    "distinct_ratio",
    "adjacent_ratio",
    "dup_line_ratio",
    "stop_word_ratio",
    "upper_ratio",
    "digit_ratio",
    "mark_ratio",
    "words_per_line",
)


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the statistics of every whole text."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.select("doc_id", "t", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    t = t.select("*", F.size("w").alias("n"), F.size("lines").alias("m"), F.length(F.array_join("w", "")).alias("chars"))

    def over(a: Column, b: str) -> Column:
        return F.when(F.col(b) > 0, a / F.col(b)).otherwise(0.0)

    def count(pattern: str) -> Column:
        return F.regexp_count("t", F.lit(pattern))

    later = F.slice("w", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0)))
    same = F.zip_with(later, "w", lambda a, b: F.when(a == b, F.lit(1)))
    return t.select(
        "doc_id",
        F.col("n").cast("double").alias("n_words"),
        over(F.col("chars"), "n").alias("mean_word_chars"),
        over(count(SYMBOLS), "n").alias("symbol_ratio"),
        over(F.size(F.array_distinct("w")), "n").alias("distinct_ratio"),
        over(F.size(F.array_compact(same)), "n").alias("adjacent_ratio"),
        over(F.size("lines") - F.size(F.array_distinct("lines")), "m").alias("dup_line_ratio"),
        over(F.size(F.filter("w", lambda x: x.isin(*dict.fromkeys(STOP_WORDS)))), "n").alias("stop_word_ratio"),
        over(count("\\p{Lu}"), "chars").alias("upper_ratio"),
        over(count("[0-9]"), "chars").alias("digit_ratio"),
        over(count("[!?]"), "n").alias("mark_ratio"),
        over(F.col("n"), "m").alias("words_per_line"),
    )


#: A rule: bounds (statistic, lowest, highest); a value v meets one if lowest < v <= highest.
Rule = tuple[tuple[str, float, float], ...]


def grow(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """Rules of all nodes of boosted trees."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    logit = np.zeros(len(y))
    rules: dict[Rule, None] = {}

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int] | None:
        best = None
        gs, hs = g[rows].sum(), h[rows].sum()
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = -np.inf
            k = int(gain.argmax())
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, k)
        return best

    def node(rows: np.ndarray, bounds: dict[int, tuple[float, float]], depth: int, g: np.ndarray, h: np.ndarray) -> None:
        if bounds:
            rules[tuple((names[f], a, b) for f, (a, b) in sorted(bounds.items()))] = None
        found = split(rows, g, h) if depth < DEPTH else None
        if found is None:
            logit[rows] -= RATE * g[rows].sum() / (h[rows].sum() + 1)
            return
        _, f, k = found
        at = float(cuts[f][k])
        a, b = bounds.get(f, (-np.inf, np.inf))
        left = binned[rows, f] <= k
        node(rows[left], bounds | {f: (a, at)}, depth + 1, g, h)
        node(rows[~left], bounds | {f: (at, b)}, depth + 1, g, h)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        node(np.arange(len(y)), {}, 0, p - y, p * (1 - p))
    return list(rules)


def holds(rule: Rule, x: np.ndarray, names: tuple[str, ...] = STATISTICS) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, a, b in rule:
        v = x[:, names.index(name)]
        out &= (v > a) & (v <= b)
    return out


def lasso(m: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient steps."""
    n, k = m.shape
    design = np.concatenate([m, np.ones((n, 1))], axis=1)
    v = np.ones(k + 1)
    for _ in range(30):
        v = design.T @ (design @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(v @ (design.T @ (design @ v))) / 1.05
    w = z = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ z, -50, 50)))
        new = z - step * (design.T @ (p - y)) / n
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / s * (new - w), new, s
    return w[:k], float(w[k])


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        """The score of a row of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            met = F.lit(True)
            for name, a, b in rule:
                if a > -np.inf:
                    met = met & (F.col(name) > a)
                if b < np.inf:
                    met = met & (F.col(name) <= b)
            total = total + F.when(met, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray) -> Ensemble:
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return Ensemble((), float(np.log(share / (1 - share))))
    rules = grow(x, y)
    weights, intercept = lasso(np.stack([holds(r, x) for r in rules], axis=1).astype(float), y) if rules else (np.zeros(0), 0.0)
    return Ensemble(tuple((r, float(w)) for r, w in zip(rules, weights) if w), intercept)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Ensemble:
    own = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    own = own.filter(~held_out(F.col("id"), FOLDS, FOLD)).withColumn("order", F.crc32(F.col("id").cast("string")))
    own = cut(own.orderBy("order", "id", "y").limit(most))
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(own.select("id").distinct()), F.col("doc_id") == F.col("id"), "left_semi")  # at most ``most`` ids
    rows = statistics(chosen).join(own, F.col("doc_id") == F.col("id")).orderBy("order", "id", "y", *STATISTICS).limit(most).toPandas()
    return train(rows[list(STATISTICS)].to_numpy(float), (rows["y"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Ensemble, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every document."""
    return statistics(docs, doc_id, text).select("doc_id", model.score().alias("score"))
