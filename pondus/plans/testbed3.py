"""Registered model, document and listing queries without an SQL oracle (rows-only
check): their results depend on solvers, seeds or nested documents.  Invariants for
them live in the test suite."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as LB
from ..operators import kpi as K
from ..operators import models as M
from ..sources.readers import dataset_listing
from . import jobs
from .testbed import frame, lineitem, register, territory_dim

FEATS = ["l_quantity", "l_discount", "l_tax"]


def _labeled(spark, sf):
    li = lineitem(spark, sf)
    return li.select(*FEATS, (F.col("l_returnflag") == "R").cast("double").alias("y"),
                     F.col("l_quantity").alias("w"))


@register("logit_fit", None)
def q_logit(spark, sf):
    coef, _ = M.logistic(_labeled(spark, sf), FEATS, "y", weight="w")
    return coef


@register("glm_inference", None)
def q_glm(spark, sf):
    return M.glm_inference(_labeled(spark, sf), FEATS, "y", weight="w")


@register("tree", None)
def q_tree(spark, sf):
    imp, _, _ = M.tree(_labeled(spark, sf), FEATS, "y", weight="w", max_depth=5, min_leaf=50)
    return imp


@register("forest", None)
def q_forest(spark, sf):
    imp, _ = M.forest(_labeled(spark, sf), FEATS, "y", weight="w")
    return imp


@register("kmeans_select", None)
def q_kmeans_select(spark, sf):
    out, _ = M.kmeans_select(lineitem(spark, sf), ["l_extendedprice", "l_quantity", "l_discount"])
    return out


@register("kmeans_profile", None)
def q_kmeans_profile(spark, sf):
    return jobs.panel_clusters(frame(spark, sf))["perfiles"]


@register("ward_two_stage", None)
def q_ward(spark, sf):
    a = M.ward_two_stage(lineitem(spark, sf), ["l_extendedprice", "l_quantity", "l_discount"],
                         k=4)
    return a.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@register("baseline_document", None)
def q_baseline(spark, sf):
    return K.baseline_documents(frame(spark, sf), territory_dim(spark, sf))


@register("freq_labeled", None)
def q_freq_labeled(spark, sf):
    return jobs.categorical_frequencies(frame(spark, sf))


@register("index_reading", None)
def q_index_reading(spark, sf):
    f = K.yearly_descriptives(frame(spark, sf))
    f = f.select("anio", (F.col("pct_ocupado") / 100).alias("ocupacion"),
                 "idx_exclusion_digital", "vulnerabilidad_social")
    return LB.index_reading(f, {"ocupacion": True, "idx_exclusion_digital": False,
                                "vulnerabilidad_social": False})


@register("dataset_listing", None)
def q_listing(spark, sf):
    return dataset_listing(spark, f"{sf}/lineitem.parquet")


SHAP_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("tree_shap", None)
def q_tree_shap(spark, sf):
    """Fit the gini tree on a target with structure (high unit price and a
    discount) and explain every line exactly; mean |φ| per feature."""
    from ..operators import explain as X
    from .bind import PERSON_KEY
    li = lineitem(spark, sf)
    d = li.select(*PERSON_KEY, *SHAP_FEATS,
                  ((F.col("l_extendedprice") / F.col("l_quantity") >= 1500)
                   & (F.col("l_discount") >= 0.03)).cast("double").alias("y"))
    explained, _ = X.explain_tree_model(d, SHAP_FEATS, "y", PERSON_KEY, max_depth=5, min_leaf=50)
    return X.shap_importance(X.shap_long(explained, SHAP_FEATS, PERSON_KEY))
