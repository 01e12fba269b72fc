"""Models on Spark ML.

Fitting is distributed (MLlib; the forest and the clusterings in modules of their own); results
come back as small DataFrames (one row per coefficient, feature, class, cluster or k).
Results that depend on a solver or a seed are checked by invariants, not by an SQL oracle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, functions as F

from ..functions.dist import norm_two_sided_p
from . import clusters, forest as forests, ml_prep


def design(df: DataFrame, features: Sequence[str], label: str | None = None,
           weight: str | None = None, scale: bool = False) -> DataFrame:
    """Listwise rows, optional population standardisation, assembled vector."""
    cols = list(features) + ([label] if label else []) + ([weight] if weight else [])
    d = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    for c in list(features) + ([label] if label else []):
        d = d.where(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`")))
    if scale:
        d = ml_prep.standardise(d, features)
    d = ml_prep.assemble(d, features)
    if weight:
        d = d.withColumn(weight, F.coalesce(F.col(weight), F.lit(0.0)))
    return d


def logistic(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None,
             C: float = 1.0, max_iter: int = 200) -> tuple[DataFrame, object]:
    """M4: L2 logistic regression with the C-parameterisation (penalty ½‖β‖²/C on the
    weighted log-likelihood sum): regParam = 1/(C·Σw), intercept unpenalised."""
    d = design(df, features, label, weight)
    sw = d.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
    kw = {"weightCol": weight} if weight else {}
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter,
                            regParam=1.0 / (C * sw), elasticNetParam=0.0, standardization=False,
                            tol=1e-10, **kw)
    m = lr.fit(d)
    spark = df.sparkSession
    rows = [(f, float(b), float(math.exp(b))) for f, b in zip(features, m.coefficients)]
    rows.append(("(intercept)", float(m.intercept), float(math.exp(m.intercept))))
    return spark.createDataFrame(rows, "variable string, coef double, odds_ratio double"), m


def glm_inference(df: DataFrame, features: Sequence[str], label: str,
                  weight: str | None = None) -> DataFrame:
    """M5/M6: binomial GLM (logit) MLE: coef, OR, 95 % CI of OR, Wald p (normal), plus
    McFadden R², log-likelihood, AIC and BIC as constant columns.  Spark reports the
    intercept's s.e./p last."""
    d = design(df, features, label, weight)
    glr = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features",
                                      labelCol=label, maxIter=100, tol=1e-10)
    if weight:
        glr = glr.setWeightCol(weight)
    schema = ("variable string, coef double, odds_ratio double, or_ci_low double, or_ci_high double, "
              "p double, se double, pseudo_r2 double, log_lik double, aic double, bic double")
    names = list(features) + ["(intercept)"]
    try:
        m = glr.fit(d)
        s = m.summary
        coefs = list(m.coefficients) + [m.intercept]
        ses = list(s.coefficientStandardErrors)
    except Exception:  # noqa: BLE001 — no rows, one class or a singular matrix: empty table, as the reference
        return df.sparkSession.createDataFrame([], schema)
    n = s.numInstances
    k = len(names)
    llf = -s.deviance / 2
    r2 = 1 - s.deviance / s.nullDeviance if s.nullDeviance else None
    rows = []
    for name, b, se in zip(names, coefs, ses):
        z = b / se if se else float("nan")
        rows.append((name, float(b), float(np.exp(b)), float(np.exp(b - 1.96 * se)),
                     float(np.exp(b + 1.96 * se)), float(norm_two_sided_p(z)), float(se)))
    out = df.sparkSession.createDataFrame(
        rows, "variable string, coef double, odds_ratio double, or_ci_low double, or_ci_high double, "
              "p double, se double")
    return out.withColumns({"pseudo_r2": F.lit(r2), "log_lik": F.lit(llf), "aic": F.lit(s.aic),
                            "bic": F.lit(k * math.log(n) + s.deviance)}).orderBy("p")


def balanced_weights(df: DataFrame, label: str, out: str = "_cw", base: str | None = None) -> DataFrame:
    """M7/M9: class weight n / (2·n_class), multiplied by a survey weight when given."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = df.count()
    d = df.join(counts, label)  # two rows: the planner broadcasts it
    cw = F.lit(float(total)) / (2 * F.col("_nc"))
    return d.withColumn(out, cw * (F.col(base) if base else F.lit(1.0))).drop("_nc")


def tree(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None,
         max_depth: int = 5, min_leaf: int = 50, seed: int = 42):
    """M8: gini decision tree; returns (importances DataFrame, summary dict, model)."""
    d = design(df, features, label, weight)
    dt = DecisionTreeClassifier(featuresCol="features", labelCol=label, impurity="gini",
                                maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=seed)
    if weight:
        dt = dt.setWeightCol(weight)
    m = dt.fit(d)
    imp = importances(df, features, m.featureImportances.toArray())
    info = {"depth": m.depth, "leaves": (m.numNodes + 1) // 2, "rules": m.toDebugString}
    return imp, info, m


def forest(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None,
           n_trees: int = 500, max_depth: int = 30, min_leaf: int = 5, seed: int = 42, key: Sequence[str] | None = None):
    """M9: random forest, √p features per split; returns (importances DataFrame, model).  The
    model's ``out_of_bag`` is the score of rows by the trees that didn't see them."""
    m = forests.fit(df, features, label, weight, key, n_trees=n_trees, max_depth=max_depth, min_leaf=min_leaf, seed=seed)
    return importances(df, features, m.importances()), m


def importances(df: DataFrame, features: Sequence[str], values) -> DataFrame:
    """Feature importance table, descending."""
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return df.sparkSession.createDataFrame(rows, "variable string, importancia double") \
             .orderBy(F.desc("importancia"), "variable")


def predicted_rate(model, df: DataFrame, features: Sequence[str], weight: str = "PONDERA", by=()) -> DataFrame:
    """Weighted mean predicted probability (%) of class 1 on another frame, by group."""
    d = df.select(*by, *[F.col(c).cast("double").alias(c) for c in features],
                  F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("_pw")).dropna(subset=list(features))
    d = ml_prep.assemble(d, features)
    p = model.transform(d).withColumn("_p1", vector_to_array("probability")[1])
    return p.groupBy(*by).agg((100 * F.sum(F.col("_p1") * F.col("_pw")) / F.sum("_pw")).alias("pct_predicho"))


def kmeans_select(df: DataFrame, features: Sequence[str], k_min: int = 2, k_max: int = 8,
                  starts: int = 10, seed: int = 42) -> tuple[DataFrame, dict]:
    """On the cluster matrix (M16), for each k the best of ``starts`` seedings by SSE and its
    Euclidean silhouette (M18) on at most 5 000 rows; (table, models by k)."""
    matrix, names = clusters.cluster_matrix(df, features)
    found = clusters.kmeans(matrix, [f"x{i}" for i in range(len(names))], range(k_min, k_max + 1), starts, seed)
    out = df.sparkSession.createDataFrame([(m.k, m.sse, s) for m, s in found], "k int, sse double, silhouette double")
    return out, {m.k: m for m, _ in found}


def kmeans_best(df: DataFrame, features: Sequence[str], k_min: int = 2, k_max: int = 8,
                starts: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame, int]:
    """(rows with their cluster, the table by k, the k with the best silhouette)."""
    table, models = kmeans_select(df, features, k_min, k_max, starts, seed)
    best = table.orderBy(F.desc_nulls_last("silhouette"), "k").first()["k"]
    matrix, names = clusters.cluster_matrix(df, features)
    cols = [f"x{i}" for i in range(len(names))]
    return models[best].transform(matrix, cols).drop(*cols), table, best


def cluster_profile(assigned: DataFrame, features: Sequence[str], cluster: str = "prediction") -> DataFrame:
    """Per cluster n, % of rows and the mean of every feature."""
    return clusters.profile(assigned, features, cluster)


def ward_two_stage(df: DataFrame, features: Sequence[str], k: int = 4, micro: int = clusters.MICRO) -> DataFrame:
    """M21 on the whole table: the cluster matrix (M16), micro-clusters in one scan, Ward's method
    on these (:func:`clusters.ward`); ``df`` with its ``cluster``."""
    matrix, names = clusters.cluster_matrix(df, features)
    cols = [f"x{i}" for i in range(len(names))]
    return clusters.ward(matrix, cols, k, micro).drop(*cols)
