"""Work that must not grow faster than its input: what is shuffled, sorted or held at once."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from framelens.operators import codebook as cb
from framelens.operators import models as md
from framelens.operators import quantiles as qt
from framelens.operators.ordering import join_by_episode


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_large_group_is_not_counted_whole(spark, monkeypatch):
    cut = []
    split = qt._split
    monkeypatch.setattr(qt, "_split", lambda *a: cut.append(1) or split(*a))
    rows = spark.range(1_100_000).select((F.xxhash64("id") / 2.0**40).alias("v")).repartition(8)
    probs = {"a": 0.01, "b": 0.5, "c": 0.99}
    got = qt.exact_quantiles(rows, [], F.col("v"), probs).first()
    assert cut and np.allclose(tuple(got), rows.agg(F.percentile("v", list(probs.values())).alias("p")).first().p, rtol=1e-12)


def test_null_keys_and_nan_groups_of_quantiles(spark):
    rows = spark.createDataFrame([(None, 1.0), ("nan", float("nan")), ("nan", 1.0), ("x", 1.0), ("x", None), ("x", 2.0)], "k string, v double")
    for cell_rows in (1, 100):
        got = {r.k: r.m for r in qt.exact_quantiles(rows, ["k"], F.col("v"), {"m": 0.5}, cell_rows=cell_rows).collect()}
        assert set(got) == {"nan", "x"} and np.isnan(got["nan"]) and got["x"] == 1.5


def test_shuffled_control_moves_rows_once(spark):
    keys = [*range(40), 7, 7, None]
    rows = spark.createDataFrame([(k, f"v{i}") for i, k in enumerate(keys)], "idx bigint, v string").repartition(3)
    out = cb.shuffled_control(rows, "idx", "v", 10, 3)
    assert plan_of(out).count("Exchange hashpartitioning") == 1 and "Join" not in plan_of(out)
    got = out.collect()
    assert out.columns == ["idx", "v", "shuffled"] and len(got) == 42  # a row without key has no batch
    for batch in range(4):
        own = [r for r in got if r.idx // 10 == batch]
        assert sorted(r.v for r in own) == sorted(r.shuffled for r in own)


def test_only_rows_of_long_episodes_are_copied(spark):
    short = [(e, f) for e in range(2000) for f in range(3)]
    chosen = spark.createDataFrame([(e, f"g{e}") for e in range(0, 2000, 2)], "episode_index bigint, g string")

    def joined(rows, how):
        return join_by_episode(spark.createDataFrame(rows, "episode_index bigint, frame_index bigint"), chosen, how)

    assert "[0,1,2,3" not in plan_of(joined(short, "left"))
    rows = [*short, *((0, f) for f in range(3, 400)), (None, 0)]
    for how, expected in (("left", len(rows)), ("inner", 3397), ("left_semi", 3397), ("left_anti", 3001)):
        got = joined(rows, how).collect()
        assert len(got) == expected and len(set(got)) == expected, how
    assert sum(r.g == "g0" for r in joined(rows, "left").collect()) == 400


def test_narrow_ridge_sums_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(md, "RowMatrix", None)
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, 5)) + 3, rng.normal(size=(300, 2))
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "i int, x array<double>, y array<double>")
    vectors = rows.repartition(7).select("i", array_to_vector("x").alias("x"), "y")
    weights, constants = md.ridge_weights(vectors, "x", "y", 2.0)
    xc, yc = x - x.mean(0), y - y.mean(0)
    assert np.allclose(weights, np.linalg.solve(xc.T @ xc + 2.0 * np.eye(5), xc.T @ yc)) and np.allclose(constants, y.mean(0) - x.mean(0) @ weights)
    got = md.linear_predictions(vectors, "x", weights, constants, "p").orderBy("i").collect()
    assert np.allclose([r.p for r in got], x @ weights + constants)
    monkeypatch.undo()
    monkeypatch.setattr(md, "BLOCK_GRAM", 3)  # wider sums stay with Spark's row matrix
    assert np.allclose(md.ridge_weights(vectors, "x", "y", 2.0)[0], weights)
