"""A quality classifier as a sparse rule ensemble over text statistics.

Boosted shallow trees on statistics of labelled texts give paths; each path is a conjunction of comparisons. A lasso
logistic regression weighs the conjunctions and drops most. What is left compiles to one Spark column expression, so
scoring runs where the rows are, without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most; those with the smallest hashes of their ids.
FIT_ROWS = 20_000
SPACE = r"[^\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text (null: empty), each a double that is never null."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chars = F.length(t).cast("double")

    def share(kept: str) -> Column:
        """The share of characters that are in the class."""
        return F.length(F.regexp_replace(t, f"[^{kept}]+", "")) / F.greatest(chars, F.lit(1.0))

    n = F.size(words).cast("double")
    lines = F.size(F.split(t, "\n")).cast("double")
    return {
        "chars": F.log1p(chars),
        "word_chars": (chars - n + 1) / F.greatest(n, F.lit(1.0)),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1.0)),
        "upper": share(r"\p{Lu}"),
        "digits": share("0-9"),
        "marks": share(r"!-&(-+/:-@\[-`{-~"),
        "stops": share(".,"),
        "exclaimed": share("!"),
        "line_words": n / lines,
        "words": F.log1p(n),
    }


NAMES = ("chars", "word_chars", "distinct_words", "upper", "digits", "marks", "stops", "exclaimed", "line_words", "words")


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, True for above or False for at most, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, limit in self.tests:
            v = x[:, NAMES.index(name)]
            out &= (v > limit) if above else (v <= limit)
        return out

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, limit in self.tests:
            out = out & ((stats[name] > limit) if above else (stats[name] <= limit))
        return out


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[Rule, ...]

    def score(self, stats: dict[str, Column]) -> Column:
        z = F.lit(self.bias)
        for r in self.rules:
            z = z + F.when(r.column(stats), F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, cuts: list[np.ndarray], least: int, tests: tuple = ()) -> list[tuple[tuple, np.ndarray]]:
    """Leaves of a regression tree on gradients g and curvatures h, as tests and rows."""

    def split(rows: np.ndarray, tests: tuple, left: int) -> list[tuple[tuple, np.ndarray]]:
        best = (1e-9, None)
        total = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        if left:
            for j, c in enumerate(cuts):
                at = np.searchsorted(c, x[rows, j], side="left")  # values at most c[i] lie in bins up to i
                gs, hs, ns = (np.cumsum(np.bincount(at, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                ok = (ns >= least) & (len(rows) - ns >= least)
                gain = np.where(ok, gs**2 / (hs + 1.0) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1.0) - total, -1)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), (j, float(c[int(gain.argmax())])))
        if best[1] is None:
            return [(tests, rows)]
        j, limit = best[1]
        up = x[rows, j] > limit
        return split(rows[~up], (*tests, (NAMES[j], False, limit)), left - 1) + split(rows[up], (*tests, (NAMES[j], True, limit)), left - 1)

    return split(np.arange(len(x)), tests, depth)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int) -> list[Rule]:
    """The distinct paths of boosted trees, inner nodes included."""
    cuts = []
    for j in range(x.shape[1]):
        own = np.unique(x[:, j])
        own = np.quantile(own, np.linspace(0, 1, 66)[1:-1]) if len(own) > 64 else (own[1:] + own[:-1]) / 2
        cuts.append(np.unique(own))
    z, found = np.full(len(y), 0.0), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        for tests, rows in grow(x, y - p, p * (1 - p), depth, cuts, max(3, len(y) // 200)):
            z[rows] += 0.3 * (y - p)[rows].sum() / ((p * (1 - p))[rows].sum() + 1.0)
            for k in range(1, len(tests) + 1):
                found[tests[:k]] = None
    return [Rule(t) for t in found]


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 500) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic regression with an L1 penalty on the weights, by accelerated proximal gradients."""
    n = max(len(y), 1)
    a1 = np.concatenate((np.ones((len(y), 1)), a), axis=1)
    rate = 4 * n / max(np.linalg.norm(a1, 2) ** 2, 1e-9)
    w = np.zeros(a1.shape[1])
    v, t = w.copy(), 1.0
    for _ in range(steps):
        u = v + rate * (a1.T @ (y - 1 / (1 + np.exp(-(a1 @ v))))) / n
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - rate * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = u + (old - 1) / t * (u - w), u
    return float(w[0]), w[1:]


def fit_rows(x: np.ndarray, y: np.ndarray, *, trees: int = 20, depth: int = 3, penalty: float = 1e-3) -> Model:
    """A model of the rows; without rows of both labels, one that always gives their share (0.5 without any)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(y) < 20 or len(np.unique(y)) < 2:
        return Model(float(np.log(share / (1 - share))), ())
    rules = tree_rules(x, y, trees, depth)
    if not rules:
        return Model(float(np.log(share / (1 - share))), ())
    bias, w = lasso(np.stack([r.holds(x) for r in rules], axis=1).astype(float), y, penalty)
    return Model(bias, tuple(Rule(r.tests, float(c)) for r, c in zip(rules, w, strict=True) if abs(c) > 1e-6))


def held_out(doc_id: Column) -> Column:
    """Whether a row's label stays unseen: CRC-32 of its id as text, modulo 4, is 2. False without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS, **options) -> Model:
    """Fits on at most the given number of labelled rows that aren't held out; only their statistics go to the driver.

    Labels that are null, or neither 0 nor 1, and rows without an id are left out; an id labelled twice counts twice.
    """
    own = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)").where(~held_out(F.col("i")))
    own = own.orderBy(F.xxhash64("i"), "i", "y").limit(rows)
    found = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(own), "i")  # at most the given rows
    table = found.select("y", *[c.alias(k) for k, c in statistics(F.col("t")).items()]).orderBy("y", *NAMES).toArrow()
    x = np.stack([table[k].to_numpy() for k in NAMES], axis=1) if len(table) else np.zeros((0, len(NAMES)))
    return fit_rows(x, table["y"].to_numpy().astype(float), **options)


def scored(docs: DataFrame, model: Model, name: str, *, text: str = "text") -> DataFrame:
    """docs with the model's score (0 to 1; empty and null texts have one too) in the column of that name."""
    return docs.withColumn(name, score_of(F.col(text), model))


def score_of(text: Column, model: Model) -> Column:
    return model.score(statistics(text))


def report(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of each document, by a model fitted on the labels that aren't held out."""
    model = fit(docs, labels, **options)
    stats = docs.select("doc_id", *[c.alias("s_" + k) for k, c in statistics(F.col("text")).items()])
    d = stats.select("doc_id", model.score({k: F.col("s_" + k) for k in NAMES}).alias("score"))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, text: str = "text", **options) -> DataFrame:
    """The documents that the model scores at the threshold or above, whole and as they were."""
    return docs.where(score_of(F.col(text), fit(docs, labels, text=text, **options)) >= threshold)
