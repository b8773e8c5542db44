"""Naive Bayes in five forms: one grouped aggregation to fit, expressions to predict."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.vectors import as_array, constant, dot, total
from tablewright.learners.base import TableModel


def _class_sums(df: DataFrame, values: Column, label: str, *wanted: str) -> list:
    """Per class: its label, row count, and the wanted vector summaries (sum, mean, variance)."""
    rows = df.select(F.col(label).cast("double").alias("c"), array_to_vector(values).alias("v"))
    summary = Summarizer.metrics(*wanted).summary(F.col("v")).alias("s")
    found = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), summary).orderBy("c").collect()  # one row per class
    return [(r.c, r.n, *[[float(x) for x in r.s[w]] for w in wanted]) for r in found]


def _priors(counts: list[int], hyper: dict, key: str = "class_prior") -> list[float]:
    given = hyper.pop(key, None)
    fit = hyper.pop("fit_prior", True)
    if given is not None:
        return [math.log(p) for p in given]
    if not fit:
        return [-math.log(len(counts))] * len(counts)
    return [math.log(c / sum(counts)) for c in counts]


def _alpha(hyper: dict) -> float:
    alpha, force = float(hyper.pop("alpha", 1.0)), hyper.pop("force_alpha", True)
    return alpha if force else max(alpha, 1e-10)


def _log(value: float) -> float:
    return math.log(value) if value > 0 else -math.inf


class BayesModel(TableModel):
    """Classes with a prior and per-feature tables; the highest score wins, ties to the first class."""

    def scores(self, df: DataFrame) -> Column:
        x = as_array(df, "features")
        kind = self.kind
        if kind == "categorical":
            return self._categorical(x)
        if kind == "bernoulli" and self.binarize is not None:
            x = F.transform(x, lambda v: F.when(v > F.lit(float(self.binarize)), F.lit(1.0)).otherwise(F.lit(0.0)))
        fields = "struct<bias: double, a: array<double>, b: array<double>>"
        table = constant([{"bias": t[0], "a": t[1], "b": t[2]} for t in self.tables], f"array<{fields}>")
        if kind == "gaussian":
            def score(k):
                spread = F.zip_with(F.zip_with(x, k["a"], lambda v, m: (v - m) * (v - m)), k["b"], lambda q, s: q / s)
                return k["bias"] - 0.5 * total(spread)
        else:
            def score(k):
                return k["bias"] + dot(x, k["a"])
        return F.transform(table, score)

    def _categorical(self, x: Column) -> Column:
        """Log probabilities looked up by feature, value and class; a value never seen counts zero."""
        bias = constant(self.bias, "array<double>")
        table = constant(self.logs, "array<array<array<double>>>")
        unseen = constant(self.unseen, "array<array<double>>")

        def of_class(b, c):
            terms = F.transform(x, lambda v, j: F.coalesce(
                F.get(F.get(F.get(table, j), F.coalesce(v.cast("int"), F.lit(-1))), c), F.get(F.get(unseen, j), c)))
            return b + total(terms)

        return F.transform(bias, of_class)

    def transform(self, df: DataFrame) -> DataFrame:
        scored = df.withColumn("scores", self.scores(df))
        ranked = F.transform(F.col("scores"), lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
        classes = constant(self.classes, "array<double>")
        return scored.withColumn("prediction", F.get(classes, F.array_min(ranked)["i"]))


def gaussian(df: DataFrame, hyper: dict, label: str = "label"):
    smoothing = float(hyper.pop("var_smoothing", 1e-9))
    x = as_array(df, "features")
    per = _class_sums(df, x, label, "mean", "variance")
    # the summaries hold sample variances
    per = [(c, n, mean, [v * (n - 1) / n for v in var]) for c, n, mean, var in per]
    width, n = len(per[0][2]), sum(p[1] for p in per)
    overall = []
    for j in range(width):
        mean = sum(p[1] * p[2][j] for p in per) / n
        overall.append(sum(p[1] * (p[3][j] + (p[2][j] - mean) ** 2) for p in per) / n)
    floor = smoothing * max(overall)
    priors = _priors([p[1] for p in per], hyper, "priors")
    tables = []
    for prior, (_, _, mean, var) in zip(priors, per):
        var = [v + floor for v in var]
        tables.append([prior - 0.5 * sum(math.log(2 * math.pi * v) for v in var), mean, var])
    return BayesModel(kind="gaussian", classes=[p[0] for p in per], tables=tables), []


def multinomial(df: DataFrame, hyper: dict, label: str = "label"):
    alpha = _alpha(hyper)
    per = _class_sums(df, as_array(df, "features"), label, "sum")
    priors = _priors([p[1] for p in per], hyper)
    tables = []
    for prior, (_, _, sums) in zip(priors, per):
        whole = sum(sums) + alpha * len(sums)
        tables.append([prior, [_log(s + alpha) - math.log(whole) for s in sums], []])
    return BayesModel(kind="multinomial", classes=[p[0] for p in per], tables=tables), []


def complement(df: DataFrame, hyper: dict, label: str = "label"):
    """Weights from the other classes' counts; the prior matters only with a single class."""
    alpha, norm = _alpha(hyper), hyper.pop("norm", False)
    per = _class_sums(df, as_array(df, "features"), label, "sum")
    priors = _priors([p[1] for p in per], hyper)
    every = [sum(p[2][j] for p in per) for j in range(len(per[0][2]))]
    tables = []
    for prior, (_, _, sums) in zip(priors, per):
        rest = [t - s + alpha for t, s in zip(every, sums)]
        logs = [_log(r / sum(rest)) for r in rest]
        weights = [v / sum(logs) for v in logs] if norm else [-v for v in logs]
        tables.append([prior if len(per) == 1 else 0.0, weights, []])
    return BayesModel(kind="complement", classes=[p[0] for p in per], tables=tables), []


def bernoulli(df: DataFrame, hyper: dict, label: str = "label"):
    alpha, threshold = _alpha(hyper), hyper.pop("binarize", 0.0)
    x = as_array(df, "features")
    if threshold is not None:
        x = F.transform(x, lambda v: F.when(v > F.lit(float(threshold)), F.lit(1.0)).otherwise(F.lit(0.0)))
    per = _class_sums(df, x, label, "sum")
    priors = _priors([p[1] for p in per], hyper)
    tables = []
    for prior, (_, n, sums) in zip(priors, per):
        yes = [_log((s + alpha) / (n + 2 * alpha)) for s in sums]
        no = [_log((n - s + alpha) / (n + 2 * alpha)) for s in sums]
        # x yes + (1 - x) no, with the constant part in the bias
        tables.append([prior + sum(no), [a - b for a, b in zip(yes, no)], []])
    return BayesModel(kind="bernoulli", classes=[p[0] for p in per], tables=tables, binarize=threshold), []


def categorical(df: DataFrame, hyper: dict, label: str = "label"):
    """Features hold category codes 0, 1, ...; counts come from one grouped pass over (class, feature, code)."""
    alpha, least = _alpha(hyper), hyper.pop("min_categories", None)
    rows = df.select(F.col(label).cast("double").alias("c"), as_array(df, "features").alias("x"))
    width = len(rows.first().x)
    classes = {r.c: r.n for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy("c").collect()}
    codes = rows.select("c", F.posexplode("x").alias("j", "v"))
    counts = codes.groupBy("c", "j", F.col("v").cast("int").alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = [0] * width
    for r in counts:
        sizes[r.j] = max(sizes[r.j], r.v + 1)
    if least is not None:
        each = least if isinstance(least, (list, tuple)) else [least] * width
        sizes = [max(s, e) for s, e in zip(sizes, each)]
    seen = {(r.c, r.j, r.v): r.n for r in counts}
    logs = [[[_log(seen.get((c, j, v), 0) + alpha) - math.log(n + alpha * sizes[j]) for c, n in classes.items()]
             for v in range(sizes[j])] for j in range(width)]
    unseen = [[_log(alpha) - math.log(n + alpha * sizes[j]) for n in classes.values()] for j in range(width)]
    bias = _priors(list(classes.values()), hyper)
    return BayesModel(kind="categorical", classes=list(classes), bias=bias, logs=logs, unseen=unseen), []
