import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.functions import fixed
from framelens.operators import states as st
from framelens.operators import stats
from framelens.sources import registry

BIG = 1e8


def parts(spark, n=6000, d=3):
    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(size=n) + BIG, rng.exponential(size=n), np.round(rng.normal(size=n), 1)], 1)
    return x, spark.createDataFrame([(i, f"d{i % 7 % 3}", v.tolist()) for i, v in enumerate(x)], "idx long, dataset string, x array<double>")


def test_merged_states_equal_the_whole(spark):
    x, rows = parts(spark)
    by_part = st.feature_state(rows, {"x": F.col("x")}, ["dataset"])
    whole = {r.pos: r for r in st.feature_state(rows, {"x": F.col("x")}).collect()}
    for r in st.merged(by_part, ["feature", "pos"]).collect():
        own = x[:, r.pos]
        assert r.n == len(own) == whole[r.pos].n and (r.low, r.high) == (own.min(), own.max())
        assert r.mean == pytest.approx(own.mean(), rel=1e-12) and math.sqrt(r.m2 / r.n) == pytest.approx(own.std(), rel=1e-7)  # far offsets do not cancel
    twice = st.merged(st.merged(by_part, ["dataset", "feature", "pos"]).unionByName(by_part.limit(0)), ["feature", "pos"])
    assert {(r.pos, r.n) for r in twice.collect()} == {(p, 6000) for p in range(3)}


def test_quantiles_stay_within_the_bound(spark):
    x, rows = parts(spark, 20_000)
    by_part = st.feature_state(rows, {"x": F.col("x")}, ["dataset"])
    long = st.feature_stats(st.merged(by_part, ["feature", "pos"])).collect()
    exact = {(r.pos, r.stat): r.value for r in stats.feature_stats(rows, {"x": F.col("x")}).collect()}
    assert {(r.pos, r.stat) for r in long} == set(exact)
    for r in long:
        if r.stat in fixed.STAT_QUANTILES:
            p, own = fixed.STAT_QUANTILES[r.stat], x[:, r.pos]
            assert (own < r.value).mean() <= p + st.rank_error() and (own <= r.value).mean() >= p - st.rank_error()
        else:
            assert r.value == pytest.approx(exact[r.pos, r.stat], rel=1e-6)


def test_summary_over_positions_and_empty_parts(spark):
    x, rows = parts(spark, 900)
    states = st.feature_state(rows, {"x": F.col("x")}, ["dataset"])
    empty = st.feature_state(rows.where("false"), {"x": F.col("x")}, ["dataset"])
    one = st.numeric_summary(states.unionByName(empty), ["feature"]).first()
    assert one["count"] == x.size and one["mean"] == pytest.approx(x.mean()) and one["max"] == x.max()
    odd = spark.createDataFrame([(1, [1.0, None]), (2, [float("nan"), 3.0]), (3, None)], "idx long, x array<double>")
    got = {r.pos: (r.n, r.mean) for r in st.feature_state(odd, {"x": F.col("x")}).collect()}
    assert got[0][0] == 2 and math.isnan(got[0][1]) and got[1] == (1, 3.0)


def test_distinct_states_are_exact_when_small_and_close_when_large(spark):
    few = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("dataset"), F.array(F.col("id") % 90, F.col("id") % 2).alias("ids"))
    states = st.distinct_state(few, F.col("ids"), ["dataset"])
    assert {r.dataset: r.n for r in states.select("dataset", st.distinct_count().alias("n")).collect()} == {"a": 45, "b": 45}
    assert st.distinct_union(states).select(st.distinct_count()).first()[0] == 90
    assert st.overlaps(states, "dataset").first().shared == 0
    many = spark.range(120_000).select(F.when(F.col("id") < 80_000, "a").otherwise("b").alias("dataset"), F.array(F.col("id") % 100_000).alias("ids"))
    states = st.distinct_state(many, F.col("ids"), ["dataset"], 12)
    error = 5 * 2 ** (-12 / 2)
    assert st.distinct_union(states, lg=12).select(st.distinct_count()).first()[0] == pytest.approx(100_000, rel=error)
    assert st.overlaps(states, "dataset").first().shared == pytest.approx(20_000, rel=4 * error)


MANIFEST = "artifact_id string, n long"


def ids(spark, path):
    return sorted(r[0] for r in registry.records(spark, path).select(F.get_json_object("value", "$.artifact_id")).collect())


def test_one_of_two_sessions_registers_an_id(spark, tmp_path):
    path = str(tmp_path / "reg")

    def run(n):
        own = spark.newSession()
        try:
            return registry.register(own.createDataFrame([("same", n)], MANIFEST), path)
        except registry.RegistryConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(run, range(4)))
    assert sorted(got, key=str) == [1, None, None, None] and ids(spark, path) == ["same"]


def test_sessions_with_different_ids_all_register(spark, tmp_path):
    path = str(tmp_path / "reg")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: registry.register(spark.newSession().createDataFrame([(f"a{n}", n), (f"b{n}", n)], MANIFEST), path), range(4)))
    assert sorted(got) == [1, 2, 3, 4]
    assert ids(spark, path) == sorted(f"{c}{n}" for c in "ab" for n in range(4))


def test_uncommitted_and_repeated_records(spark, tmp_path):
    path = str(tmp_path / "reg")
    assert registry.records(spark, path).count() == 0
    spark.createDataFrame([('{"artifact_id":"dead"}',)], "value string").write.text(f"{path}/records-dead")  # its job died before the commit
    registry.register(spark.createDataFrame([("dead", 1)], MANIFEST), path)
    assert ids(spark, path) == ["dead"]
    with pytest.raises(registry.RegistryConflict):
        registry.register(spark.createDataFrame([("x", 1), ("x", 2)], MANIFEST), path)
    with pytest.raises(registry.RegistryConflict):
        registry.register(spark.createDataFrame([("y", 1), ("dead", 2)], MANIFEST), path)
    assert ids(spark, path) == ["dead"]
