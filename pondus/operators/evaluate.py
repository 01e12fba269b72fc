"""Model evaluation on a score column (M10–M13) and linear SHAP.

ROC and AUC reduce the scored table to one row per distinct score first (positives and
negatives per score), then use the ordered kernel: exact, tie-aware, no single-task sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from . import ordered


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Real × predicted counts for classes 0/1 (long form)."""
    return df.groupBy(F.col(label).cast("int").alias("real"),
                      F.col(prediction).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class precision/recall/F1/support (0 when undefined), accuracy, macro and
    weighted averages — arithmetic on the four confusion counts (one aggregate)."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    c = df.agg(*[F.count(F.when((y == a) & (p == b), 1)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    rows = []
    for k in (0, 1):
        tp = F.col(f"c{k}{k}")
        fp = F.col(f"c{1 - k}{k}")
        fn = F.col(f"c{k}{1 - k}")
        prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
        rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
        rows.append(F.struct(F.lit(str(k)).alias("clase"), prec.alias("precision"), rec.alias("recall"),
                             f1.alias("f1"), (tp + fn).cast("double").alias("support")))
    per = c.select(F.explode(F.array(*rows)).alias("r"), "*").select("r.*", "c00", "c01", "c10", "c11")
    n = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    w = Window.partitionBy()
    acc = ((F.col("c00") + F.col("c11")) / n)
    out = per.select("clase", "precision", "recall", "f1", "support", acc.alias("accuracy"),
                     F.avg("f1").over(w).alias("f1_macro"),
                     (F.sum(F.col("f1") * F.col("support")).over(w) / F.sum("support").over(w)).alias("f1_weighted"))
    return out


def _score_table(df: DataFrame, label: str, score: str, by=None) -> DataFrame:
    by = ordered._as_list(by)
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
              .groupBy(*by, F.col(score).cast("double").alias("_v"))
              .agg(F.count(F.when(F.col(label) == 1, 1)).cast("double").alias("_pos"),
                   F.count(F.when(F.col(label) != 1, 1)).cast("double").alias("_neg")))


def roc_points(df: DataFrame, label: str, score: str, *, method: str = "bucketed") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, thresholds descending: the
    point at threshold s counts rows with score ≥ s."""
    t = _score_table(df, label, score).withColumn("_negv", -F.col("_v"))
    t = ordered.running_weight(t, ["_negv"], ["_pos", "_neg"], method=method, excl=["_pb", "_nb"], total=["_P", "_N"])
    return t.select(F.col("_v").alias("threshold"),
                    ((F.col("_nb") + F.col("_neg")) / F.col("_N")).alias("fpr"),
                    ((F.col("_pb") + F.col("_pos")) / F.col("_P")).alias("tpr"))


def auc(df: DataFrame, label: str, score: str, *, method: str = "bucketed") -> DataFrame:
    """Exact AUC = Σ_s pos_s·(neg below s + neg_s/2) / (P·N); null with one class."""
    t = _score_table(df, label, score)
    t = ordered.running_weight(t, ["_v"], "_neg", method=method, excl="_nb", total=None)
    a = t.agg(F.sum(F.col("_pos") * (F.col("_nb") + F.col("_neg") / 2)).alias("_s"),
              F.sum("_pos").alias("P"), F.sum("_neg").alias("N"))
    return a.select(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_s") / (F.col("P") * F.col("N")))
                    .alias("auc"), F.col("P").cast("long").alias("n_pos"), F.col("N").cast("long").alias("n_neg"))


def linear_shap(df: DataFrame, coefficients: Mapping[str, float]) -> DataFrame:
    """φ_j = β_j (x_j − E x_j) as column expressions; mean |φ_j| per feature and its
    % share — no sampling (E x_j is a scalar subquery per feature)."""
    feats = list(coefficients)
    d = df.select(*[F.col(c).cast("double") for c in feats])
    means = d.agg(*[F.avg(c).alias(c) for c in feats])
    phi = d.select(*[(F.lit(float(coefficients[c])) * (F.col(c) - means.select(c).scalar())).alias(c)
                     for c in feats])
    imp = phi.agg(*[F.avg(F.abs(c)).alias(c) for c in feats]).unpivot([], feats, "variable", "mean_abs_shap")
    return imp.withColumn("pct", 100 * F.col("mean_abs_shap")
                          / F.sum("mean_abs_shap").over(Window.partitionBy()))
