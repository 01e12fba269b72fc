"""A null group is a group: ordered statistics, comparisons, levers; keep-first and the cache."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from pondus.functions.expr import join_groups
from pondus.operators import corr, joins, kpi, models, ordered, scenario, weighted  # noqa: F401
from pondus.sources import readers


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(i, rng.choice(["a", "b", None, None]), float(rng.choice([10, 20, 20, 30, rng.randint(1, 500)])), float(rng.randint(1, 9))) for i in range(600)]
    return spark.createDataFrame(data, "k long, g string, y double, w double").repartition(3), data


def test_every_grouped_statistic_keeps_the_null_group(rows):
    df, data = rows
    renamed = df.fillna("zz", ["g"])  # the same with a name for the group

    def by_group(f, d):
        return sorted(((None if r["g"] == "zz" else r["g"], *[v for c, v in sorted(r.asDict().items()) if c != "g"]) for r in f(d).collect()), key=repr)

    for f in (lambda d: ordered.gini(d, "y", "w", "g"), lambda d: ordered.lower_weighted_median(d, "y", "w", "g"),
              lambda d: ordered.weighted_quantiles(d, "y", "w", [.1, .5, .9], "g"), lambda d: ordered.unweighted_quantiles(d, "y", [.25, .5], "g"),
              lambda d: ordered.quantile_table(d, "y", "w", ["k"], 5, "g"), lambda d: weighted.group_compare(d, "y", "g", "w"),
              lambda d: weighted.summary(d, "y", "w", by="g"), lambda d: ordered.theil(d, "y", "w", "g"),
              lambda d: ordered.greedy_prefix(d, "w", ["k"], F.lit(50.0), "g").groupBy("g").agg(F.count_if("_take").alias("n"))):
        got, want = by_group(f, df), by_group(f, renamed)
        assert {g[0] for g in got} == {"a", "b", None} and len(got) == len(want)
        for a, b in zip(got, want):
            assert all(x == (pytest.approx(y, rel=1e-12) if isinstance(y, float) else y) for x, y in zip(a, b))


def test_group_compare_against_numpy(rows):
    df, data = rows
    for r in weighted.group_compare(df, "y", "g", "w").collect():
        y, w = (np.array([d[i] for d in data if d[1] == r["g"]]) for i in (2, 3))
        o = np.argsort(y, kind="stable")
        y, w = y[o], w[o]
        cum = np.cumsum(w)
        assert r["w_sum"] == w.sum() and r["mean"] == pytest.approx((w * y).sum() / w.sum())
        assert r["median_lower"] == y[np.argmax(cum >= w.sum() / 2)]
        assert r["gini"] == pytest.approx(2 * (w * (cum - w / 2) * y).sum() / (w.sum() * (w * y).sum()) - (1 - 1 / w.sum()))


def test_join_groups_keeps_columns_apart(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "`g.h` string, v int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "`g.h` string, u int")
    assert sorted(map(tuple, join_groups(a, b, ["g.h"]).collect()), key=repr) == [(None, 1, 3)]
    assert sorted(map(tuple, join_groups(a, b, ["g.h"], "left").collect()), key=repr) == [("x", 2, None), (None, 1, 3)]


def brute_flip(data, target):
    """Rows that flip, in one group: (key, weight, bad)."""
    w = lambda r: 1.0 if r[1] is None else r[1]
    total, good = sum(map(w, data)), sum(w(r) for r in data if not r[2])
    if target <= 100 * good / total + 0.05:
        return set()
    extra, out, have = target / 100 * total - good, set(), 0.0
    for r in sorted((r for r in data if r[2]), key=lambda r: (-w(r), r[0])):
        if have >= extra:
            break
        out.add(r[0])
        have += w(r)
    return out


def test_levers_by_cut_off_against_a_loop(spark):
    rng = random.Random(5)
    data = [(i, rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 2.0, 7.5]), rng.choice([0.0, 1.0, 1.0, None])) for i in range(400)]
    df = spark.createDataFrame(data, "k long, g string, w double, bad double")
    targets = {"a": 70.0, "b": 5.0, None: 90.0}
    out = scenario.flip_to_target(df, F.lit(True), "bad", spark.createDataFrame(list(targets.items()), "g string, target double"), ["k"], "g", weight="w")
    assert out.columns == ["k", "g", "w", "bad", "_flipped"]
    got = {r["k"]: r for r in out.collect()}
    want = set().union(*[brute_flip([(k, w, b == 1.0) for k, x, w, b in data if x == g and b is not None], t) for g, t in targets.items()])
    assert {k for k, r in got.items() if r["_flipped"]} == want
    assert all(got[k]["bad"] == (0.0 if k in want else b) for k, _, _, b in data)


def test_scenario_levers_do_not_meet(spark):
    """All cut-offs come from the same rows, so one scenario equals its levers one after another."""
    rng = random.Random(9)
    flag = lambda: rng.choice([0.0, 1.0, None])
    cols = ["k", "g", "PONDERA", "decil_ingreso", "ocupado", "superior", "informal_proxy", "secundario_completo", "quintil_alto", "quintil_bajo", "desocupado",
            "excl_sin_pc", "excl_sin_internet_hogar", "excl_sin_uso_cel", "excl_sin_uso_pc", "excl_sin_uso_internet"]
    data = [(i, rng.choice([1, 2, None]), float(rng.randint(1, 5)), float(rng.randint(1, 10)), *[flag() for _ in range(len(cols) - 4)]) for i in range(300)]
    df = spark.createDataFrame(data, ", ".join(f"{c} {'long' if c == 'k' else 'int' if c == 'g' else 'double'}" for c in cols))
    from pondus.functions.expr import row_mean
    from pondus.plans.frame import ACCESS_FLAGS, USE_FLAGS
    df = df.withColumn("idx_exclusion_digital", row_mean(ACCESS_FLAGS + USE_FLAGS))
    targets = spark.createDataFrame([(1, 80.0, 60.0, 90.0), (2, None, 70.0, 10.0), (None, 95.0, None, 99.0)], "g int, internet_quintil_i double, pct_superior double, pct_empleo_formal double")
    got = {r["k"]: r for r in scenario.apply_scenario(df, targets, ["k"], "g", exclusion_threshold=F.lit(0.5)).collect()}
    d = df
    for lever, mask, col, good, bad in (("internet_quintil_i", F.col("decil_ingreso") <= 2, "excl_sin_internet_hogar", 0.0, 1.0), ("pct_superior", F.lit(True), "superior", 1.0, 0.0),
                                        ("pct_empleo_formal", F.col("ocupado") == 1, "informal_proxy", 0.0, 1.0)):
        t = targets.select("g", F.col(lever).alias("target")).where("target IS NOT NULL")
        d = scenario.flip_to_target(d, mask, col, t, ["k"], "g", good_value=good, bad_value=bad).drop("_flipped")
    want = {r["k"]: r for r in d.collect()}
    assert all(got[k][c] == want[k][c] for k in want for c in ("excl_sin_internet_hogar", "superior", "informal_proxy"))
    assert sum(got[i]["superior"] != data[i][5] for i in range(300)) > 10


def test_comparison_keeps_a_null_territory(spark):
    a = spark.createDataFrame([(None, 1.0), (1, 2.0), (2, None)], "t int, x double")
    b = spark.createDataFrame([(None, 3.0), (1, 5.0), (3, 4.0)], "t int, x double")
    got = {r["t"]: (r["base"], r["escenario"], r["delta"]) for r in joins.compare_indicators(a, b, ["t"], ["x"]).collect()}
    assert got == {None: (1.0, 3.0, 2.0), 1: (2.0, 5.0, 3.0), 2: (None, None, None), 3: (None, 4.0, None)}


def test_keep_first_is_an_aggregate(spark):
    rng = random.Random(3)
    data = [(rng.choice([1, 2, 3, None]), rng.choice([5, 6, None]), i, rng.choice(["x", None])) for i in range(200)]
    df = spark.createDataFrame(data, "key int, o int, id long, `a.b` string")
    got = joins.keep_first(df, ["key"], ["o", "id"])
    assert got.columns == df.columns and "Window" not in got._jdf.queryExecution().toString()
    want = {}
    for r in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want.setdefault(r[0], r)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.values(), key=repr)
    assert joins.keep_first(df.select("key"), ["key"], []).count() == 4


def _table(spark, n):
    return spark.range(n).withColumn("p", F.col("id") % 2)


def test_cache_after_a_failed_write(spark, tmpdir_path):
    path, calls = f"{tmpdir_path}/cache", []

    def build():
        calls.append(1)
        return _table(spark, 6)

    _table(spark, 2).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # half of a table
    assert readers.cached_table(spark, path, build).count() == 6 and len(calls) == 1
    assert readers.cached_table(spark, path, build).count() == 6 and len(calls) == 1
    only = f"{tmpdir_path}/only-temporary"
    spark.range(1).write.parquet(f"{only}/_temporary/0")
    assert readers.cached_table(spark, only, build, ["p"]).where("p = 1").count() == 3 and len(calls) == 2


def test_cache_with_two_builders(spark, tmpdir_path):
    path, gate = f"{tmpdir_path}/raced", threading.Barrier(2)
    got = []

    def build():
        gate.wait(60)
        return _table(spark, 40)

    threads = [threading.Thread(target=lambda: got.append(readers.cached_table(spark, path, build).count())) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert got == [40, 40] and readers.cached_table(spark, path, build).count() == 40


def test_small_faults(spark):
    with pytest.raises(ValueError, match="two items"):
        corr.cronbach(spark.createDataFrame([(1.0,)], "a double"), ["a"])
    none = spark.createDataFrame([], "x double, y double")
    assert models.glm_inference(none, ["x"], "y").count() == 0
