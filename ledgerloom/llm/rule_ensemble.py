"""Quality classifier as a sparse rule ensemble.

Text statistics are Spark expressions. Trees grown on a bounded sample of labelled rows give their
paths as conjunctive rules over the statistics; a logistic model with lasso weights keeps few of
them, beside the statistics themselves in clipped linear form. The kept rules are compiled into one
column expression, so scoring all documents is a projection without Python.

Cases: null and empty texts have all statistics zero and are scored like any other; without
labelled rows every score is zero, with one class only it is that class; labels that repeat an id
count once, as their minimum; null labels and ids are not learnt from; a null doc_id is scored and
counts as held out; repeated rows repeat their score; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_held_out, read

SAMPLE = 6000  # labelled rows learnt from, at most, in the order of a hash of the id
TREES = 40
DEPTH = 3
LEAF = 10
PENALTY = 0.02  # share of the smallest penalty that keeps no rule
THRESHOLD = 0.3

Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", bound), all of which must hold


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``stats`` of text statistics, all finite."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))  # noqa: E731  characters the pattern does not take
    parts = docs.withColumn("_s", F.struct(
        F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "").alias("words"),
        F.length(text).alias("chars"),
        left("[^A-Z]+").alias("capitals"),
        left(r"[\p{L}\p{N}\s]+").alias("symbols"),
        left("[^0-9]+").alias("digits"),
        left(r"[^.]+").alias("stops"),
        left(r"[^\n]+").alias("breaks"),
    ))
    n = F.greatest(F.size("_s.words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("_s.chars"), F.lit(1)).cast("double")
    stats = F.struct(
        F.log1p(F.size("_s.words").cast("double")).alias("log_words"),
        (F.size(F.array_distinct("_s.words")) / n).alias("distinct_share"),
        (F.col("_s.chars") / n).alias("word_length"),
        (F.col("_s.capitals") / chars).alias("capital_share"),
        (F.col("_s.symbols") / chars).alias("symbol_share"),
        (F.col("_s.digits") / chars).alias("digit_share"),
        (F.col("_s.stops") / n).alias("stops_per_word"),
        (F.log1p(F.col("_s.breaks").cast("double"))).alias("log_breaks"),
    )
    return parts.withColumn("stats", stats).drop("_s")


# --- learning, on at most SAMPLE rows --------------------------------------------------------------
def grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, rng, depth: int, path: tuple, found: set) -> None:
    """Adds the path of every node under a variance-splitting tree; each node looks at some of the statistics."""
    if path:
        found.add(path)
    if depth == 0 or len(rows) < 2 * LEAF or y[rows].min() == y[rows].max():
        return
    best = None
    for f in rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False).tolist():
        order = rows[np.argsort(x[rows, f], kind="stable")]
        v, total = x[order, f], np.cumsum(y[order])
        k = np.arange(LEAF, len(rows) - LEAF + 1)
        k = k[v[k - 1] < v[np.minimum(k, len(rows) - 1)]]
        if not len(k):
            continue
        gain = total[k - 1] ** 2 / k + (total[-1] - total[k - 1]) ** 2 / (len(rows) - k)
        i = int(gain.argmax())
        if best is None or gain[i] > best[0]:
            best = (gain[i], f, float((v[k[i] - 1] + v[k[i]]) / 2), order[: k[i]], order[k[i] :])
    if best:
        _, f, bound, low, high = best
        grow(x, y, low, rng, depth - 1, (*path, (f, "<=", bound)), found)
        grow(x, y, high, rng, depth - 1, (*path, (f, ">", bound)), found)


def holds(x: np.ndarray, rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, sign, bound in rule:
        out &= x[:, f] <= bound if sign == "<=" else x[:, f] > bound
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Logistic weights and intercept with an L1 penalty, by accelerated proximal gradient steps on scaled columns."""
    step = 4 / max(np.linalg.norm(z, 2) ** 2 / len(z) + 1, 1e-9)
    w = seen = np.zeros(z.shape[1])
    b = seen_b = math.log(y.mean() / (1 - y.mean()))
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ seen + seen_b, -30, 30)))
        g = z.T @ (p - y) / len(y)
        new = seen - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = seen_b - step * float((p - y).mean())
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        seen, seen_b = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        moved = max(float(np.abs(new - w).max(initial=0)), abs(new_b - b))
        w, b, t = new, new_b, t2
        if moved < 1e-7:
            break
    return w, b


class Ensemble:
    """Rules, linear terms and their weights."""

    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray):
        self.names, self.rules, self.terms, self.base = names, [], [], 0.0
        if not len(y) or y.min() == y.max():
            self.base = (-30.0 if not len(y) or y[0] == 0 else 30.0)
            return
        rng = np.random.default_rng(0)
        found: set = set()
        for _ in range(TREES):
            rows = rng.choice(len(y), max(2, len(y) // 2), replace=False)
            grow(x, y.astype(float), rows, rng, DEPTH, (), found)
        seen, rules, columns = set(), [], []
        for rule in sorted(found, key=lambda r: (len(r), r)):
            c = holds(x, rule)
            if 0 < c.sum() < len(c) and (key := np.packbits(c).tobytes()) not in seen:
                seen.add(key)
                rules.append(rule)
                columns.append(c)
        low, high = np.quantile(x, [0.025, 0.975], axis=0)
        linear = np.clip(x, low, high)
        spread = linear.std(axis=0)
        use = np.flatnonzero(spread > 0)
        z = np.column_stack([np.array(columns, float).T.reshape(len(y), len(columns)), 0.4 * linear[:, use] / spread[use]])
        mean = z.mean(axis=0)
        z -= mean
        weight, self.base = lasso(z, y.astype(float), PENALTY * float(np.abs(z.T @ (y - y.mean())).max()) / len(y))
        self.base -= float(mean @ weight)
        self.rules = [(r, float(w)) for r, w in zip(rules, weight) if w]
        self.terms = [(int(f), float(0.4 * w / spread[f]), float(low[f]), float(high[f])) for f, w in zip(use, weight[len(rules) :]) if w]

    def column(self, stats: str = "stats") -> Column:
        """The score as a Spark expression over the statistics."""
        total = F.lit(self.base)
        for f, w, low, high in self.terms:
            total = total + F.lit(w) * F.least(F.greatest(F.col(f"{stats}.{self.names[f]}"), F.lit(low)), F.lit(high))
        for rule, w in self.rules:
            every = None
            for f, sign, bound in rule:
                c = F.col(f"{stats}.{self.names[f]}")
                c = c <= bound if sign == "<=" else c > bound
                every = c if every is None else every & c
            total = total + F.when(every, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def readable(self) -> list[tuple[str, float]]:
        """The kept rules as text with their weights, strongest first."""
        return sorted(((" and ".join(f"{self.names[f]} {s} {b:.4g}" for f, s, b in r), w) for r, w in self.rules), key=lambda x: -abs(x[1]))


def train(docs: DataFrame, labels: DataFrame) -> Ensemble | None:
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~is_held_out("doc_id", 5, 0))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("example")).agg(F.min("quality").cast("int").alias("label"))
    drawn = F.broadcast(usable.orderBy(F.xxhash64("example"), "example").limit(SAMPLE))  # bounded by SAMPLE
    rows = docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("example"))
    rows = with_statistics(rows.groupBy("example", "label").agg(F.min("text").alias("text"))).select("example", "label", "stats.*")
    found = rows.toPandas().sort_values("example")
    if not len(found):
        return None
    names = list(found.columns[2:])
    return Ensemble(names, found[names].to_numpy(float), found["label"].to_numpy())


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels)
    scored = with_statistics(docs.select("doc_id", "text"))
    score = model.column() if model else F.lit(0.0)
    out = scored.select("doc_id", is_held_out("doc_id", 5, 0).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
