"""Model jobs end to end (M1, M4, M5, M8, M9): prepare, split, fit, evaluate on held-out rows.

Preparation is a lazy plan over the whole table: medians of the numeric predictors, one 0/1
column per level of the others, a split by key hash, survey times balanced class weights.
Fits are MLlib's, the forest's :mod:`forest`'s; confusion, ROC, AUC and report run on the test rows' probabilities.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..operators import evaluate as E
from ..operators import forest as forests
from ..operators import ml_prep as P
from ..operators import models as M
from ..session import materialise


@dataclass
class Prepared:
    """``frame`` has the key, ``predictors``, ``label``, ``weight``, ``split`` and ``features``."""

    frame: DataFrame
    predictors: list[str]
    label: str
    weight: str
    left_out: list[str]

    def info(self) -> DataFrame:
        """One row: n, n_train, n_test, share of the positive class, predictors, left out."""
        train = F.col("split") == "train"
        return self.frame.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"),
            F.avg(F.col(self.label).cast("double")).alias("balance"),
        ).withColumns({"predictores": F.array(*map(F.lit, self.predictors)),
                       "excluidas": F.array(*map(F.lit, self.left_out)) if self.left_out else F.array().cast("array<string>")})


def prepare(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], weight: str | None = None, *,
            max_levels: int = 30, train_fraction: float = 0.8, seed: int = 42, balanced: bool = False) -> Prepared:
    """M1/M2/M3: the design table of a classification job.

    Rows without a label are dropped.  Numeric predictors get their median where null; others
    become one 0/1 column per level but the first, null as all zeros.  A predictor with more
    than ``max_levels`` levels, or one that never varies, is left out and listed.
    """
    types = dict(df.dtypes)
    numeric = [c for c in features if types[c] in P.NUMERIC or types[c].startswith("decimal") or types[c] == "boolean"]
    others = [c for c in features if c not in numeric]
    d = df.select(*key, *[F.col(f"`{c}`").cast("double").alias(c) if c in numeric else F.col(f"`{c}`") for c in features],
                  F.col(label).cast("int").alias(label),
                  (F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)).alias("_weight")).where(F.col(label).isNotNull())
    levels = P.category_levels(d, others, max_levels) if others else {}
    wide = {c for c in others if c not in levels}
    d = P.one_hot(d.select(*[F.col(f"`{c}`") for c in d.columns if c not in wide]), levels)
    dummies = [f"{c}_{v}" for c, lv in levels.items() for v in lv[1:]]
    d = P.impute_median(d, numeric) if numeric else d
    d = materialise(P.hash_split(d, key, train_fraction, seed), "design")
    varies = lambda c: F.coalesce(F.min(F.col(f"`{c}`")) != F.max(F.col(f"`{c}`")), F.lit(False))
    spread = d.agg(*[varies(c).alias(f"c{i}") for i, c in enumerate(numeric + dummies)]).first() if numeric + dummies else []
    predictors = [c for c, several in zip(numeric + dummies, spread) if several]
    single = [c for c in numeric if c not in predictors] + [c for c in levels if not any(f"{c}_{v}" in predictors for v in levels[c][1:])]
    if balanced:
        d = M.balanced_weights(d, label, "_balanced", "_weight").drop("_weight").withColumnRenamed("_balanced", "_weight")
    d = P.assemble(d, predictors)
    return Prepared(d, predictors, label, "_weight", sorted({*wide, *single}))


def _estimator(kind: str, p: Prepared, total: float, options: dict):
    shared = {"featuresCol": "features", "labelCol": p.label, "weightCol": p.weight}
    if kind == "logistic":
        return LogisticRegression(**shared, **{"maxIter": 200, "regParam": 1.0 / total, "standardization": False, "tol": 1e-10} | options)
    if kind == "tree":
        return DecisionTreeClassifier(**shared, **{"maxDepth": 5, "minInstancesPerNode": 50, "seed": 42} | options)
    raise ValueError(f"kind {kind!r}; one of logistic, tree, forest")


def fit_and_evaluate(p: Prepared, kind: str, **options) -> dict[str, object]:
    """M4/M8/M9: fit on the training rows; on the test rows: confusion, report, ROC and AUC.

    Also ``info`` (M1), ``model``, the coefficients or importances, and the ``oob`` score of a
    forest, whose options are those of :func:`forest.fit`.  One class among the training rows gives a ValueError.
    """
    train = p.frame.where(F.col("split") == "train")
    sums = {r[0]: r[1] for r in train.groupBy(p.label).agg(F.sum(p.weight)).collect()}
    if len(sums) < 2:
        raise ValueError("the training rows hold one class")
    if kind == "forest":
        model = forests.fit(train, p.predictors, p.label, p.weight, **options)
    else:
        model = _estimator(kind, p, sum(sums.values()), options).fit(train)
    scored = materialise(model.transform(p.frame.where(F.col("split") == "test")).select(
        p.label, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability")[1].alias("score")), "scored")
    out = evaluated(scored, p.label) | {"info": p.info(), "model": model}
    if kind == "logistic":
        rows = [(c, float(b)) for c, b in zip([*p.predictors, "(intercept)"], [*model.coefficients, model.intercept])]
        out["coefficients"] = p.frame.sparkSession.createDataFrame(rows, "variable string, coef double").withColumn("odds_ratio", F.exp("coef"))
    elif kind == "forest":
        out |= {"importances": M.importances(p.frame, p.predictors, model.importances()), "oob": model.out_of_bag()}
    else:
        out["importances"] = M.importances(p.frame, p.predictors, model.featureImportances.toArray())
    return out


def evaluated(scored: DataFrame, label: str, prediction: str = "prediction", score: str = "score") -> dict[str, DataFrame]:
    """M10–M13 of scored rows."""
    return {"confusion": E.confusion(scored, label, prediction), "report": E.classification_report(scored, label, prediction),
            "roc": E.roc_points(scored, label, score), "auc": E.auc(scored, label, score)}
