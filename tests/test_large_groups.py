"""Results must not depend on how groups are cut, and one hot key must not change them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.operators import buckets as bk
from framelens.operators import frames as fr
from framelens.operators.ordering import lookup_counted, positions, random_ranks, running_before
from framelens.operators.quantiles import exact_quantiles

CHUNKS = [3, 7, 65536]


@pytest.fixture(scope="module")
def hot(spark):
    """Sixty frames in one episode and a few in three others, in random row order."""
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for episode, length in ((4, 60), (1, 9), (9, 12), (2, 1)):
        for f in range(length):
            rows.append((i, episode, f, int(f < length - 4), [float(rng.integers(0, 9)), float(f)], int(rng.integers(0, 2))))
            i += 1
    rng.shuffle(rows)
    return spark.createDataFrame(
        rows, "idx bigint, episode_index bigint, frame_index bigint, valid bigint, action array<double>, bucket bigint").repartition(5)


def table(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("chunk", CHUNKS[:2])
def test_windows_do_not_depend_on_the_chunk(hot, chunk):
    whole = CHUNKS[-1]

    def same(make, *columns):
        assert table(make(chunk), *columns) == table(make(whole), *columns)

    same(lambda c: fr.future_action_mean(hot, 3, 2, c), "idx", "future_mean")
    same(lambda c: fr.action_window_sum(hot, 3, 2, c), "idx", "label", "label_valid")
    same(lambda c: fr.window_values(hot, "action", [-2, 0, 3], c), "idx", "window", "is_pad")
    same(lambda c: fr.past_future_pairs(hot, "action", 2, c), "idx", "past", "future")
    same(lambda c: fr.progress_context(hot, c), "idx", "progress", "valid_len")
    same(lambda c: fr.prefix_violations(hot.withColumn("valid", F.col("bucket")), c), "episode_index", "violations")
    same(lambda c: fr.cutoff_first_valid(hot, 40, c), "idx", "valid")
    same(lambda c: fr.contiguous_runs(hot, "idx", "bucket", c), "bucket", "start", "end")
    same(lambda c: bk.run_lengths(hot, [], c), "bucket", "mean_run_length", "max_run_length", "adjacent_repeat_fraction")


def test_window_longer_than_chunk_is_refused(hot):
    with pytest.raises(ValueError):
        fr.future_action_mean(hot, 5, 2, 3)


def test_runs_against_brute_force(hot):
    rows = sorted((r.episode_index, r.frame_index, r.bucket) for r in hot.collect())
    lengths = {0: [], 1: []}
    previous = None
    for e, f, b in rows:
        if previous == (e, f - 1, b):
            lengths[b][-1] += 1
        else:
            lengths[b].append(1)
        previous = (e, f, b)
    got = {r.bucket: r for r in bk.run_lengths(hot, [], 7).collect()}
    for b, runs in lengths.items():
        assert got[b].mean_run_length == pytest.approx(np.mean(runs)) and got[b].max_run_length == max(runs)
        assert got[b].adjacent_repeat_fraction == pytest.approx((sum(runs) - len(runs)) / max(sum(runs) - 1, 1))


def test_positions_across_slices(spark):
    rows = spark.createDataFrame([(g, t) for g, n in (("hot", 50), ("cold", 5)) for t in range(n)], "g string, t bigint").repartition(4)
    got = positions(rows, ["g"], F.floor(F.col("t") / 6), ["t"], "p", "n").collect()
    assert all(r.p == r.t and r.n == (50 if r.g == "hot" else 5) for r in got) and len(got) == 55


def test_running_before_across_slices(spark):
    rows = spark.createDataFrame([(i, i % 5) for i in range(100)], "k bigint, v bigint").repartition(3)
    got = running_before(rows, ["k"], F.floor(F.col("k") / 7), {"v": F.col("v")}, totals=True).orderBy("k").collect()
    assert [r.v_before for r in got] == [sum(i % 5 for i in range(k)) for k in range(100)] and got[0].v_total == 200


@pytest.mark.parametrize("settings", [{}, {"cell_rows": 20, "bins": 3}, {"cell_rows": 300, "bins": 8}, {"cell_rows": 1, "bins": 2}])
def test_quantiles_of_hot_groups(spark, settings):
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(size=700), 1: rng.exponential(size=90) ** 3, 2: np.repeat(5.0, 400), 3: np.array([1.0]),
              4: np.concatenate([np.repeat(2.0, 300), rng.normal(size=50)])}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k int, v double").repartition(6)
    probs = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.77, "e": 1.0}
    got = {r.k: r for r in exact_quantiles(rows, ["k"], F.col("v"), probs, **settings).collect()}
    assert len(got) == 5
    for k, vs in groups.items():
        assert np.allclose(got[k][1:], np.quantile(vs, list(probs.values())))
    everything = exact_quantiles(rows, [], F.col("v"), probs, **settings).first()
    assert np.allclose(tuple(everything), np.quantile(np.concatenate(list(groups.values())), list(probs.values())))


def test_lookup_with_a_hot_key(spark):
    keys = ["hot"] * 500 + [f"k{i}" for i in range(700)]
    rows = spark.createDataFrame(list(enumerate(keys)), "idx bigint, k string").repartition(4)
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = lookup_counted(rows, counts, "k", "n", "idx").collect()
    assert len(got) == 1200 and all(r.n == (500 if r.k == "hot" else 1) for r in got)


def test_random_ranks_do_not_depend_on_partitions(spark):
    a = random_ranks(spark.range(500).toDF("k"), "k", 1)
    b = random_ranks(spark.range(500).toDF("k").repartition(9), "k", 1)
    assert a.exceptAll(b).count() == 0 and sorted(r["rank"] for r in a.collect()) == list(range(1, 501))
    kept = random_ranks(spark.range(500).toDF("k"), "k", 1, limit=lambda n: F.lit(37))
    assert kept.count() == 37 and kept.exceptAll(a.where("rank <= 37")).count() == 0


def test_code_vectors_of_a_hot_code(spark):
    from framelens.operators.codebook import with_code_vectors

    rows = spark.createDataFrame([(i, 0 if i < 400 else i % 7) for i in range(600)], "idx bigint, code_id bigint")
    codes = spark.createDataFrame([(c, [float(c)]) for c in range(7)], "code_id bigint, code array<double>")
    got = with_code_vectors(rows, codes, max_numbers=0)
    assert got.count() == 600 and got.where(F.col("code")[0] != F.col("code_id")).count() == 0
    assert got.select(sorted(got.columns)).exceptAll(with_code_vectors(rows, codes).select(sorted(got.columns))).count() == 0


def test_episode_joins(spark, hot):
    chosen = spark.createDataFrame([(4,), (2,)], "episode_index bigint")
    assert fr.select_episodes(hot, chosen).count() == 61 and fr.except_episodes(hot, chosen).count() == 21
    assert fr.select_episodes(hot, None).count() == 82


@pytest.mark.parametrize("settings", [{}, {"cell_rows": 20, "bins": 3}, {"cell_rows": 5, "bins": 64}])
def test_quantiles_of_wide_ranges(spark, settings):
    rng = np.random.default_rng(8)
    groups = {
        "log": 10.0 ** rng.uniform(-30, 0, 400),
        "tiny": np.concatenate([rng.uniform(0, 5e-320, 200), [0.0, -0.0]]),
        "hot": np.concatenate([np.full(300, 2.5), rng.normal(size=90)]),
        "inf": np.concatenate([rng.uniform(size=300), [np.inf, -np.inf]]),
        "nan": np.concatenate([rng.uniform(size=300), [np.nan]]),
        "huge": rng.uniform(-1, 1, 200) * 1e300,
    }
    rows = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double").repartition(6)
    probs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.99}
    got = {r.k: tuple(r[1:]) for r in exact_quantiles(rows, ["k"], F.col("v"), probs, **settings).collect()}
    for k, vs in groups.items():
        assert np.allclose(got[k], np.quantile(vs, list(probs.values())), rtol=1e-12, atol=0, equal_nan=True), k
