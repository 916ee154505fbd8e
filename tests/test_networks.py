import os
import time

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from framelens import session
from framelens.operators import models as md
from framelens.operators import network as net


def curved(spark, n=3000, parts=4):
    """A folded direction of many, which neither a line nor random units can follow, and a saturating difference."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 24))
    along = rng.normal(size=24) / np.sqrt(24)
    y = np.stack([np.abs(x @ along), np.tanh(3 * (x[:, 2] - x[:, 3]))], 1)
    rows = [(i, i // 20, x[i].tolist(), y[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "idx bigint, episode_index bigint, continuous array<double>, y array<double>").repartition(parts)


SETTINGS = net.Settings(hidden=(32, 16), rounds=120, patience=15, rate=1e-2)


def test_network_learns_what_ridge_cannot(spark):
    rows = curved(spark)
    scores = md.run_probes(rows, {"continuous": "continuous"}, {"t": "y"}, models=("ridge", "relu", "mlp"), split_mode="row", network=SETTINGS)
    r2 = {(r.probe_model, r.action_dim): r.r2 for r in scores.collect()}
    assert r2["ridge", 0] < 0.2 and r2["mlp", 0] > 0.8 and r2["mlp", 0] > r2["relu", 0] + 0.2, r2
    assert r2["mlp", 1] > 0.8, r2
    assert set(scores.columns) >= {"probe_model", "split_mode", "feature_set", "target", "action_dim", "r2", "mse", "n_train", "n_test"}


def test_training_does_not_depend_on_partitions(spark):
    rows = curved(spark, 400)
    few = net.Settings(hidden=(8,), rounds=4, seed=3)
    trained = []
    for parts in (1, 5, 40):  # forty parts add up in groups
        vectors = rows.repartition(parts, "idx").select("idx", array_to_vector("continuous").alias("x"), "y")
        table, n_batches = net.blocks(vectors, "idx", "x", "y", 400, 3, block_rows=16, batch_rows=100)
        assert n_batches == 4 and table.agg(F.sum("n")).first()[0] == 400
        trained.append(net.train(table.repartition(parts), n_batches, 24, [(0, 1), (0, 2)], few))
    for other in trained[1:]:
        for own, same in zip(trained[0], other):
            assert all(np.allclose(a, b, rtol=1e-6, atol=1e-9) for a, b in zip(own, same))


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 3)), rng.normal(size=(7, 2))
    weights = net.start([3, 5, 2], rng)
    flat = np.concatenate([w.ravel() for w in weights])
    found, loss = net.gradient(x, y, weights)
    assert loss == pytest.approx(((net.forward(x, weights)[-1] - y) ** 2).sum() / 2)
    for i in range(len(flat)):
        moved = [net.gradient(x, y, net._shaped(flat + step * (np.arange(len(flat)) == i), weights))[1] for step in (1e-6, -1e-6)]
        assert found[i] == pytest.approx((moved[0] - moved[1]) / 2e-6, abs=1e-5)


def test_held_out_loss_stops_training(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.normal(size=3).tolist(), rng.normal(size=1).tolist()) for i in range(300)], "idx bigint, x array<double>, y array<double>")
    vectors = rows.select("idx", array_to_vector("x").alias("x"), "y")
    table, n_batches = net.blocks(vectors, "idx", "x", "y", 300, 0)
    weights = net.train(table, n_batches, 3, [(0, 1)], net.Settings(hidden=(64,), rounds=60, patience=2, rate=3e-2))
    guess = net.forward(rng.normal(size=(200, 3)), weights[0])[-1]
    assert np.abs(guess).mean() < 0.6  # noise has nothing to learn; without stopping it would be followed


def test_a_step_opens_only_the_files_of_its_batch(spark):
    vectors = curved(spark, 4000).select("idx", array_to_vector("continuous").alias("x"), "y")
    table, n_batches = net.blocks(vectors, "idx", "x", "y", 4000, 3, block_rows=16, batch_rows=500)
    files = [{r.f for r in table.where(F.col("batch") == b).select(F.input_file_name().alias("f")).distinct().collect()} for b in range(-1, n_batches)]
    assert n_batches == 8 and all(files)
    assert sum(map(len, files)) == len(set().union(*files)) == len(table.inputFiles())
    assert table.agg(F.sum("n")).first()[0] == 4000


def test_feature_sets_share_passes_and_nothing_else(spark, monkeypatch):
    rows = curved(spark, 600).withColumn("other", F.slice("continuous", 1, 5))
    few = net.Settings(hidden=(8,), rounds=5, seed=3)
    passes, passed = [], net._passed
    monkeypatch.setattr(net, "_passed", lambda *a, **k: passes.append(1) or passed(*a, **k))

    def scores(features):
        passes.clear()
        found = md.run_probes(rows, features, {"t": "y"}, models=("mlp",), split_mode="row", network=few)
        return {(r.feature_set, r.action_dim): r.mse for r in found.collect()}, len(passes)

    both, n_both = scores({"a": "continuous", "b": "other"})
    a, n_a = scores({"a": "continuous"})
    b, n_b = scores({"b": "other"})
    assert both == pytest.approx({**a, **b}, rel=1e-6) and len(both) == 4
    assert n_both == max(n_a, n_b)


def labelled(spark, n=400):
    """Narrow rows, and their label vectors (single precision, as stored) by key."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, 12)).astype("float32").astype(float)
    y = x[:, :2] + rng.normal(size=(n, 2)) * 0.1
    rows = spark.createDataFrame([(i, i // 20, y[i].tolist()) for i in range(n)], "idx bigint, episode_index bigint, y array<double>")
    wide = spark.createDataFrame([(i, x[i].tolist(), [int(v > 0) for v in x[i, :3]]) for i in range(n)], "idx bigint, continuous array<double>, ids array<bigint>")
    return rows, wide


def probe_scores(rows, wide, models):
    found = md.run_probes(rows, {"continuous": "continuous", "ids_onehot": "ids"}, {"t": "y"}, models=models, split_mode="row", wide=wide, network=net.Settings(hidden=(8,), rounds=4))
    return {(r.probe_model, r.feature_set, r.action_dim): r.mse for r in found.collect()}


def test_large_columns_are_stored_in_parts_and_only_once(spark, monkeypatch):
    rows, wide = labelled(spark)
    whole = probe_scores(rows, wide, ("mlp",))
    stored, parts, written, in_parts = [], [], md.written, session.written_in_parts
    monkeypatch.setattr(md, "written", lambda s, df, *a: stored.append(set(df.columns)) or written(s, df, *a))
    for module in (session, md):
        monkeypatch.setattr(module, "written_in_parts", lambda s, part, n, by=None: parts.append(n) or in_parts(s, part, n, by))
    monkeypatch.setattr(session, "PART_BYTES", 20_000)
    monkeypatch.setattr(net.blocks, "__defaults__", (0, True, 16, 50))
    assert probe_scores(rows, wide, ("mlp",)).keys() == whole.keys()
    assert len(parts) == 2 and min(parts) > 1, parts  # the rows with their vectors, and their blocks
    assert not any(c in {"continuous", "_s"} or c.startswith("_x") for columns in stored for c in columns), stored
    monkeypatch.setattr(net.blocks, "__defaults__", (0, True, net.BLOCK_ROWS, net.BATCH_ROWS))
    assert probe_scores(rows, wide, ("mlp",)) == pytest.approx(whole, rel=1e-6)


def test_parts_hold_every_row_once(spark, monkeypatch):
    rows, wide = labelled(spark)
    split = rows.withColumn("side", F.lit("train"))
    vectors = wide.join(rows, "idx").select("idx", array_to_vector("continuous").alias("x"), array_to_vector(F.col("ids").cast("array<double>")).alias("h"), "y")

    def stored():
        joined = md._with_wide(split, wide, "idx")
        table, n_batches = net.blocks(vectors, "idx", ["x", "h"], "y", 400, 3, block_rows=16, batch_rows=50)
        found = sorted((r.batch, r.n, tuple(map(bytes, r.x)), bytes(r.y)) for r in table.collect())
        return sorted(joined.select("idx", "side", "continuous", "ids", "y").collect()), found, n_batches

    whole = stored()
    monkeypatch.setattr(session, "PART_BYTES", 10_000)
    assert stored() == whole
    assert len(whole[0]) == 400 and sum(n for _, n, _, _ in whole[1]) == 400


def test_blocks_hold_features_in_the_narrowest_exact_type(spark):
    rows, wide = labelled(spark)
    vectors = wide.join(rows, "idx").select("idx", array_to_vector("continuous").alias("x"), array_to_vector(F.col("ids").cast("array<double>")).alias("h"), "y")
    table, _ = net.blocks(vectors, "idx", ["x", "h"], "y", 400, block_rows=50)
    found = table.collect()
    assert all(len(r.x[0]) == 4 * 12 * r.n and len(r.x[1]) == 3 * r.n and len(r.y) == 8 * 2 * r.n for r in found)
    read = np.vstack([net.Features(12).read(r.x[0], r.n) for r in found])
    own = np.array([r.continuous for r in wide.collect()])
    assert (read[np.lexsort(read.T)] == own[np.lexsort(own.T)]).all()
    scaled = net.Features(12, own.mean(0), own.std(0)).read(found[0].x[0], found[0].n)
    assert (scaled == (net.Features(12).read(found[0].x[0], found[0].n) - own.mean(0)) / own.std(0)).all()
    for values in ([0.1, 2.0], [1e300, 1.0], [np.nan, 1.0], [300.5, -129.0], [np.inf, 0.0]):
        raw = net.narrowed(np.array(values))
        assert np.array_equal(net._numbers(raw, 1, 2)[0], values, equal_nan=True)


def test_a_stored_table_leaves_no_shuffle_files(spark):
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {f for folder in folders for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle")}

    before = shuffled()
    table = session.written(spark, spark.range(100_000).repartition(7).groupBy((F.col("id") % 1000).alias("k")).count())
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert table.count() == 1000


def test_ridge_inputs_are_not_stored(spark, monkeypatch):
    rows, wide = labelled(spark)
    stored, written = [], md.written
    monkeypatch.setattr(md, "written", lambda s, df, *a: stored.append(set(df.columns)) or written(s, df, *a))
    found = probe_scores(rows, wide, ("ridge",))
    assert len(found) == 4 and max(v for (_, name, _), v in found.items() if name == "continuous") < 0.02
    assert not any("_x" in columns for columns in stored), stored
