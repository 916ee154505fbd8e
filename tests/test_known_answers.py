"""Small inputs with known answers."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from framelens.functions import tensors, text
from framelens.operators import buckets as bk
from framelens.operators import codebook as cb
from framelens.operators import frames as fr
from framelens.operators import information as inf
from framelens.operators import labelers as lab
from framelens.operators import labels as lb
from framelens.operators import models as md
from framelens.operators import sampling as sp
from framelens.operators import scores as sc
from framelens.operators import stats as st
from framelens.operators import wide as wd
from framelens.sources import datasets


def frame_table(spark, valid, episodes, actions=None):
    seen, rows = {}, []
    for i, (v, e) in enumerate(zip(valid, episodes)):
        f = seen.get(e, 0)
        seen[e] = f + 1
        rows.append((i, e, f, v, [float(x) for x in (actions[i] if actions else [i])]))
    return spark.createDataFrame(rows, "idx bigint, episode_index bigint, frame_index bigint, valid bigint, action array<double>")


VALID, EPISODES = [1, 1, 0, 1, 1, 1, 0], [0, 0, 0, 1, 1, 1, 1]


def test_valid_context_and_progress(spark):
    frames = frame_table(spark, VALID, EPISODES)
    assert [r.episode_index for r in fr.valid_rows(frames).orderBy("idx").collect()] == [0, 0, 1, 1, 1]
    rows = fr.progress_context(frames).orderBy("idx").collect()
    assert [r.progress for r in rows] == [0, 1, 0, 1, 2]
    assert [r.valid_len for r in rows] == [2, 2, 3, 3, 3]


def test_future_mean_starts_after_the_frame(spark):
    frames = frame_table(spark, [1, 1, 0, 0, 0], [0] * 5, [(2 * i, 2 * i + 1) for i in range(5)])
    rows = fr.future_action_mean(frames, 2, 2).orderBy("idx").collect()
    assert [r.future_mean for r in rows] == [[3.0, 4.0], [5.0, 6.0]]


def test_future_mean_needs_the_whole_window(spark):
    frames = frame_table(spark, [1, 1, 1, 1, 0], [0] * 5)
    with pytest.raises(Exception, match="too short"):
        fr.future_action_mean(frames, 2, 1).collect()
    with pytest.raises(ValueError):
        fr.future_action_mean(frames, 0, 1)


def test_window_sum_starts_at_the_frame(spark):
    frames = frame_table(spark, [1] * 3, [0] * 3, [(0, 1), (2, 3), (4, 5)])
    rows = fr.action_window_sum(frames, 2, 2).orderBy("idx").collect()
    assert [r.label_valid for r in rows] == [1, 1, 0]
    assert [r.label for r in rows] == [[2.0, 4.0], [6.0, 8.0], None]


def test_prefix_violation(spark):
    rows = fr.prefix_violations(frame_table(spark, [1, 0, 1, 1, 1, 0], [0, 0, 0, 1, 1, 1]))
    assert {r.episode_index: r.violations for r in rows.collect()} == {0: 1, 1: 0}


def test_cutoffs(spark):
    frames = frame_table(spark, VALID, EPISODES)
    assert fr.cutoff_whole_episode(frames, 3).count() == 7
    assert fr.cutoff_whole_episode(frames, 2).count() == 3
    assert [r.valid for r in fr.cutoff_first_valid(frames, 3).orderBy("idx").collect()] == [1, 1, 0, 1, 0, 0, 0]


def test_unique_rows(spark):
    rows = spark.createDataFrame([Row(ids=[i]) for i in (7, 7, 3, 7, 3)])
    assert st.unique_rows(rows, F.col("ids")).first() == Row(unique_rows=2, singleton_rows=0, max_usage=3)


def test_sequence_buckets(spark):
    ids = [[1, 2], [1, 2], [3, 4], [3, 4], [9, 9]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "idx bigint, ids array<bigint>")
    got = bk.sequence_buckets(rows).orderBy("bucket").collect()
    assert [(r.bucket, r.bucket_label, r.bucket_count) for r in got] == [(0, "1 2", 2), (1, "3 4", 2), (2, "9 9", 1)]
    assigned = bk.assign_sequence_buckets(rows).orderBy("idx").collect()
    assert [r.bucket for r in assigned] == [0, 0, 1, 1, 2]


def test_perfect_buckets_explain_everything(spark):
    rows = spark.createDataFrame([(b, [2.0 * b, 2.0 * b]) for b in (0, 0, 1, 1)], "bucket bigint, x array<double>")
    out = bk.variance_explained(bk.action_stats(rows, [], "x", 2), [], 2).first()
    assert out.mean_variance_explained == 1.0 and out.mean_within_bucket_std == 0.0
    assert out.total_rows == 4 and out.active_buckets == 2 and out.max_bucket_fraction == 0.5


def test_constant_target_explains_nothing(spark):
    rows = spark.createDataFrame([(b, [1.0]) for b in (0, 1)], "bucket bigint, x array<double>")
    assert bk.variance_explained(bk.action_stats(rows, [], "x", 1), [], 1).first().mean_variance_explained == 0.0


def test_bucket_context(spark):
    rows = spark.createDataFrame(
        [(b, i // 4, i % 4, i % 4, 4) for i, b in enumerate([0, 0, 1, 1, 0, 0, 0, 0])],
        "bucket bigint, episode_index bigint, frame_index bigint, progress bigint, valid_len bigint")
    got = {r.bucket: r for r in bk.context_stats(rows, [], 4).collect()}
    assert (got[0].episode_coverage, got[0].mean_run_length, got[0].max_run_length, got[0].progress_bin_coverage) == (1, 3, 4, 1)
    assert got[0].max_episode_fraction == pytest.approx(4 / 6)
    assert got[0].adjacent_repeat_fraction == pytest.approx(4 / 5)
    assert (got[1].episode_coverage, got[1].max_episode_fraction, got[1].mean_run_length, got[1].progress_bin_coverage) == (0.5, 1, 2, 0.5)
    summary = bk.context_summary(rows, [], 4).first()
    assert 0 <= summary.bucket_episode_nmi <= 1 and summary.total_rows == 8


def test_empty_context_is_zero(spark):
    rows = spark.createDataFrame([], "bucket bigint, episode_index bigint, frame_index bigint, progress bigint, valid_len bigint")
    out = bk.context_summary(rows, [], 4).first()
    assert out.total_rows == 0 and out.weighted_mean_run_length == 0.0 and out.bucket_episode_nmi == 0.0


def test_consistency(spark):
    pairs = spark.createDataFrame([(0, 0, 4), (1, 0, 1), (1, 1, 1), (1, 2, 1), (1, 3, 1)], "action_bucket bigint, latent_bucket bigint, n bigint")
    got = {r.action_bucket: r for r in bk.consistency_stats(pairs, []).collect()}
    assert (got[0].top_latent_fraction, got[0].active_latent_buckets, got[0].latent_buckets_for_80pct_mass) == (1.0, 1, 1)
    assert (got[1].top_latent_fraction, got[1].active_latent_buckets, got[1].latent_buckets_for_80pct_mass) == (0.25, 4, 4)
    assert got[1].top_latent_bucket == 0 and got[1].latent_perplexity == pytest.approx(4)
    info = inf.mutual_information(pairs, [], "action_bucket", "latent_bucket", "n").first()
    assert info.mi == pytest.approx(0.380396, abs=1e-6) and info.nmi == pytest.approx(0.430631, abs=1e-6)


def test_nmi_conventions_and_symmetry(spark):
    single = spark.createDataFrame([(0, 0, 5)], "x bigint, y bigint, n bigint")
    assert inf.mutual_information(single, [], "x", "y", "n").first()[:2] == (0.0, 1.0)
    free = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 1)], "x bigint, y bigint, n bigint")
    assert inf.mutual_information(free, [], "x", "y", "n").first().nmi == pytest.approx(0)
    some = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 1, 5)], "x bigint, y bigint, n bigint")
    a = inf.mutual_information(some, [], "x", "y", "n").first()
    b = inf.mutual_information(some, [], "y", "x", "n").first()
    assert a.mi == pytest.approx(b.mi) and a.nmi == pytest.approx(b.nmi)


def test_entropy_of_counts(spark):
    counts = spark.createDataFrame([("a", 1), ("a", 1), ("b", 9), ("c", 0)], "k string, count bigint")
    got = {r.k: r.entropy for r in inf.entropy(counts, ["k"]).collect()}
    assert got["a"] == pytest.approx(math.log(2)) and got["b"] == 0.0 and got["c"] == 0.0


def test_quantile_bins(spark):
    rows = spark.createDataFrame([(i, 0, float(i)) for i in range(8)] + [(9, 1, 5.0), (10, 1, 5.0)], "idx bigint, dim int, y double")
    got = inf.quantile_bins(rows, ["dim"], "y", 4).orderBy("idx").collect()
    assert [r.bin for r in got if r.dim == 0] == [0, 0, 1, 1, 2, 2, 3, 3]
    assert [r.bin for r in got if r.dim == 1] == [0, 0]


def test_progress_bin_bounds(spark):
    rows = spark.createDataFrame([(0, 1), (0, 4), (3, 4), (2, 4)], "p bigint, n bigint")
    assert [r[0] for r in rows.select(fr.progress_bin(F.col("p"), F.col("n"), 4)).collect()] == [0, 0, 3, 2]
    with pytest.raises(ValueError):
        fr.progress_bin(F.col("p"), F.col("n"), 0)


def test_expand_and_scatter(spark):
    frames = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "idx bigint, valid bigint")
    labels = spark.createDataFrame([(0, [1.0, 2.0]), (2, [3.0, 4.0])], "idx bigint, x array<double>")
    fill = {"x": F.array(F.lit(0.0), F.lit(0.0))}
    assert [r.x for r in lb.expand_compact(frames, labels, fill).orderBy("idx").collect()] == [[1, 2], [0, 0], [3, 4]]
    got = lb.scatter_labels(frames, labels.where("idx = 0"), fill).orderBy("idx").collect()
    assert [(r.x, r.valid) for r in got] == [([1, 2], 1), ([0, 0], 0), ([0, 0], 0)]


def test_contract_violations(spark):
    frames = spark.createDataFrame([(0, 7, 1), (1, 7, 0), (2, 7, 1)], "idx bigint, episode_index bigint, valid bigint")
    labels = spark.createDataFrame([(0,), (1,)], "idx bigint")
    assert lb.contract_violations(frames, labels).first()[1:] == (2, 2, 1, 1)


def test_pairing_mismatch_names_the_index(spark):
    a = spark.createDataFrame([(0, 0), (1, 0)], "idx bigint, episode_index bigint")
    b = spark.createDataFrame([(0, 0), (2, 0)], "idx bigint, episode_index bigint")
    assert {(r.idx, r.mismatch) for r in lb.pairing_mismatches(a, b).collect()} == {(1, "index"), (2, "index")}


def test_wrong_label_size_fails(spark):
    rows = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    with pytest.raises(Exception, match="3 elements"):
        lb.cast_to_plan(rows, {"x": ("array<float>", 3)}).collect()


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, -1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(tensors.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([1, 0, 0])


def test_cosine_summaries(spark):
    scores = spark.createDataFrame([(0, 0, "a", 0.1), (1, 0, "a", 0.3), (2, 1, "b", 0.5)], "idx bigint, episode_index bigint, latent_format string, spcfc double")
    got = {r.latent_format: r for r in sc.cosine_summary(scores).collect()}
    assert got["a"].mean == pytest.approx(0.2) and got["a"]["count"] == 2
    by = {(r.latent_format, r.episode_index): r for r in sc.cosine_by_episode(scores).collect()}
    assert by[("a", 0)].std == pytest.approx(0.1414213562) and by[("b", 1)].std is None


def test_losses(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.5, 2.0, 3.0), (0, 2.0, 2.5, 4.0, 3.0)],
                                 "episode_index bigint, loss_normal double, loss_hard_codebook double, loss_shuffled_action_tokens double, loss_zeroed_action_tokens double")
    summary = {r.condition: r for r in sc.loss_summary(rows).collect()}
    assert summary["normal"].mean == 1.5 and len(summary) == 4
    compared = {r.condition: r for r in sc.loss_comparison(rows).collect()}
    shuffled = compared["shuffled_action_tokens"]
    assert (shuffled.mean_delta_vs_normal, shuffled.mean_ratio_vs_normal, shuffled.fraction_worse_than_normal) == (1.5, 2.0, 1.0)
    assert sc.loss_by_episode(rows).first().loss_zeroed_action_tokens == 3.0
    assert sc.loss_by_episode(rows.drop("episode_index")) is None


def test_reconstruction(spark):
    rows = spark.createDataFrame([(0, [1.0] * 4, [1.0] * 4, [0.5] * 4)], "idx bigint, t array<double>, a array<double>, b array<double>")
    got = {r.latent_format: r for r in sc.reconstruction_metrics(rows, ["idx"], "t", {"ids": F.col("a"), "x": F.col("b")}).collect()}
    assert (got["ids"].mse, got["ids"].mae) == (0, 0) and got["ids"].psnr_db == pytest.approx(120)
    assert (got["x"].mse, got["x"].mae) == (0.25, 0.5)
    metrics = spark.createDataFrame([("ids", 0.0, 0.0, 1.0), ("ids", 1.0, 1.0, 3.0)], "latent_format string, mse double, mae double, psnr_db double")
    out = sc.reconstruction_summary(metrics).first()
    assert (out.mean_mse, out.median_mae, out.display_name) == (0.5, 0.5, "Reconstruction (IDs)")


def test_nearest_code_small_and_blocked(spark):
    tokens = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5])], "idx bigint, vector array<double>")
    codes = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "code_id bigint, code array<double>")
    whole = [(r.idx, r.code_id, r.sq_distance) for r in cb.nearest_code(tokens, codes, ["idx"]).orderBy("idx").collect()]
    blocked = [(r.idx, r.code_id, r.sq_distance) for r in cb.nearest_code(tokens, codes, ["idx"], max_numbers=0, block=2).orderBy("idx").collect()]
    assert whole == blocked == [(0, 1, 0.0), (1, 2, 0.0), (2, 1, 0.0), (3, 0, 0.5)]


def test_relaxed_moves_by_the_residual(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0, 3.0], [1.0, 1.0, 1.0]) for i in range(5)], "idx bigint, d array<double>, c array<double>")
    out = cb.relaxed(rows, "d", "c", "idx", 1, 3)
    moved = [r[0] for r in out.select(tensors.l2_norm(tensors.difference(F.col("relaxed"), F.col("d")))).collect()]
    assert moved == pytest.approx([math.sqrt(5)] * 5)
    assert out.select("relaxed").distinct().count() == 5


def test_shuffled_control_is_a_permutation_per_batch(spark):
    rows = spark.createDataFrame([(i, i) for i in range(41)], "idx bigint, v bigint")
    got = cb.shuffled_control(rows, "idx", "v", 10, 3).collect()
    assert sorted(r.shuffled for r in got) == list(range(41))
    assert all(r.idx // 10 == r.shuffled // 10 for r in got)
    assert {r.idx: r.shuffled for r in got}[40] == 40


def test_token_grid(spark):
    flat = [float(i) for i in range(12)]
    rows = spark.createDataFrame([(flat,)], "x array<double>")
    grid = rows.select(tensors.reshape(F.col("x"), (1, 2, 2, 3)).alias("g")).first().g
    assert grid[0][1][1] == [9.0, 10.0, 11.0]
    with pytest.raises(Exception, match="13 elements"):
        rows.select(tensors.reshape(F.col("x"), (13,))).collect()
    with pytest.raises(Exception, match="exactly one frame"):
        rows.select(tensors.squeeze_time(F.array("x", "x"))).collect()


def test_feature_stats(spark):
    frames = spark.createDataFrame([(v, [float(i + 1), 10.0 * (i + 1)]) for i, v in enumerate([1, 0, 1, 1, 1])], "valid bigint, x array<double>")
    got = {(r.pos, r.stat): r.value for r in st.feature_stats(fr.valid_rows(frames), {"x": F.col("x")}).collect()}
    assert got[(0, "count")] == 4 and got[(0, "mean")] == 3.25 and got[(1, "max")] == 50 and got[(0, "q50")] == 3.5
    assert got[(0, "std")] == pytest.approx(1.4790199)
    assert st.feature_stats(frames.where("false"), {"x": F.col("x")}).count() == 0


def test_offset_seconds(spark):
    assert spark.range(1).select(tensors.offset_seconds(3, 10.0).alias("s")).first().s == pytest.approx([0.0, 0.1, 0.2])


def test_spec_check_and_override(spark):
    schema = "group_id bigint, episode bigint, mode string, constant_value double, mean double, std double, low double, high double"
    none = (None,) * 4
    spec = spark.createDataFrame([(0, 1, "constant", 7.0, *none), (0, 2, "constant", 7.0, *none), (1, 2, "constant", 8.0, *none),
                                  (1, 3, "constant", 8.0, *none)], schema)
    assert [(r.episode, r.problem) for r in lab.spec_violations(spec).collect()] == [(2, "assigned to multiple groups")]
    frames = spark.createDataFrame([(i, e) for i, e in enumerate([0, 1, 1, 2])], "idx bigint, episode_index bigint")
    groups = spark.createDataFrame([(1, "constant", 7.0)], "episode_index bigint, mode string, constant_value double")
    rows = lb.override_by_episode(frames, groups, {"mode": F.lit("constant"), "constant_value": F.lit(0.0)})
    rows = rows.withColumns({c: F.lit(0.0) for c in ("mean", "std", "low", "high")})
    labels = lab.synthetic_labels(rows, (2, 3), 0).orderBy("idx").collect()
    assert [r.label for r in labels] == [[[x] * 3] * 2 for x in (0.0, 7.0, 7.0, 0.0)]


def test_random_labels(spark):
    rows = spark.range(200).withColumnRenamed("id", "idx").withColumns({
        "mode": F.when(F.col("idx") % 2 == 0, "gaussian").otherwise("uniform"), "constant_value": F.lit(0.0), "mean": F.lit(1.5),
        "std": F.lit(0.0), "low": F.lit(-0.5), "high": F.lit(0.5)})
    got = lab.synthetic_labels(rows, (5,), 3, "double")
    values = [x for r in got.where("mode = 'uniform'").collect() for x in r.label]
    assert all(-0.5 <= x < 0.5 for x in values) and len(set(values)) == 500 and abs(sum(values) / 500) < 0.05
    assert all(x == 1.5 for r in got.where("mode = 'gaussian'").collect() for x in r.label)
    again = lab.synthetic_labels(rows.repartition(7), (5,), 3, "double")
    assert got.exceptAll(again).count() == 0
    spread = lab.synthetic_labels(rows.withColumn("std", F.lit(2.0)).withColumn("mode", F.lit("gaussian")), (5,), 3, "double")
    flat = [x for r in spread.collect() for x in r.label]
    mean = sum(flat) / len(flat)
    assert abs(mean - 1.5) < 0.25 and abs(math.sqrt(sum((x - mean) ** 2 for x in flat) / len(flat)) - 2) < 0.2
    with pytest.raises(Exception, match="floating type"):
        lab.synthetic_labels(rows, (5,), 3, "bigint").collect()


def test_checkpoint_paths(spark):
    rows = spark.createDataFrame([("/a/run1/wrap/checkpoints/070000/pretrained_model",), ("/a/run 2/checkpoints/010000/pretrained_model",),
                                  ("/models/final.",), (None,)], "p string")
    got = rows.select(*[c.alias(n) for n, c in text.checkpoint_columns(F.col("p"), "wrap").items()]).collect()
    assert [(r.source_checkpoint_id, r.source_checkpoint_step, r.source_run_name) for r in got] == [
        ("run1__070000", "070000", "run1"), ("run_2__010000", "010000", "run 2"), ("final", None, None), (None, None, None)]
    assert got[0].source_run_path == "/a/run1" and got[3].source_checkpoint_dir is None


def test_names(spark):
    rows = spark.createDataFrame([(" a b/c. ",), ("...",), (None,)], "s string")
    assert [r[0] for r in rows.select(text.sanitize_token(F.col("s"))).collect()] == ["a_b_c", "unknown", "unknown"]
    one = spark.range(1)
    null = F.lit(None).cast("string")
    assert one.select(text.artifact_id(F.lit("s"), F.lit("v1"), null, F.lit("out"))).first()[0] == "s__v1__out"
    located = text.registry_location([null, F.lit("/x/runs/y/runs/z")], "runs")
    assert one.select(located).first()[0] == "/x/runs/y/runs/analysis_registry/artifacts.jsonl"
    assert one.select(text.registry_location([F.lit("/x")], "runs")).first()[0] is None
    assert one.select(text.registry_location([F.lit("/x/runs")], "runs", "/other.jsonl")).first()[0] == "/other.jsonl"
    nothing = F.lit(None).cast("bigint")
    assert one.select(text.sample_title(F.lit(1), nothing, F.lit(5))).first()[0] == "ep 1 | idx 5"
    assert one.select(text.sample_title(nothing, nothing, nothing)).first()[0] == "sample"


def test_registry_row_equals_manifest(spark, tmp_path):
    manifests = spark.createDataFrame([("a", 3)], "artifact_id string, num_rows bigint")
    now = text.utc_text(F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    full = datasets.with_registration(manifests, F.lit("/r/m.json"), F.lit("/r/reg"), now)
    datasets.register(full, str(tmp_path / "reg"))
    read = datasets.parse_manifests(spark.read.text(str(tmp_path / "reg")), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.schema))
    assert read.select(full.columns).exceptAll(full).count() == 0


def test_kmeans_finds_two_clusters(spark):
    rows = spark.createDataFrame([(i, [(-3.0 if i < 24 else 3.0) + 0.01 * (i % 5)] * 4) for i in range(48)], "idx bigint, x array<double>")
    assigned, summary = md.kmeans_buckets(rows, "x", 2, 48, "idx", 0, "cluster_")
    assert sorted(r["count"] for r in assigned.groupBy("bucket").count().collect()) == [24, 24]
    assert assigned.groupBy((F.col("idx") < 24).alias("s"), "bucket").count().count() == 2
    out = summary.first()
    assert out.effective_clusters == 2 and out.cluster_center_l2_norm_mean == pytest.approx(2, abs=0.1)
    assert md.kmeans_buckets(rows.where("idx < 3"), "x", 8, None, "idx", 0, "cluster_")[1].first().effective_clusters == 3


def probe_table(spark, n=120):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 6))
    y = x @ rng.normal(size=(6, 2)) + 0.5
    rows = [(i, i // 8, x[i].tolist(), y[i].tolist(), [int(v > 0) for v in x[i, :2]]) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "idx bigint, episode_index bigint, continuous array<double>, y array<double>, ids array<bigint>")


def test_ridge_probe_scores_and_weights(spark):
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    x, y, rows = probe_table(spark)
    train = rows.select(array_to_vector("continuous").alias("x"), "y")
    weights, intercepts = md.ridge_weights(train, "x", "y", 2.0)
    xc, yc = x - x.mean(0), y - y.mean(0)
    want = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(6), xc.T @ yc)
    assert np.allclose(weights, want) and np.allclose(intercepts, y.mean(0) - x.mean(0) @ want)
    iterated, constant = wd.ridge(train, "x", "y", 2, 2.0)
    assert np.allclose(iterated, want, atol=1e-9) and np.allclose(constant, intercepts, atol=1e-9)
    scores = md.run_probes(rows, {"continuous": "continuous", "ids_onehot": "ids", "absent": "nope"}, {"t": "y"}, models=("ridge",), alpha=1e-3, test_share=0.25)
    got = {(r.feature_set, r.action_dim): r for r in scores.collect()}
    assert len(got) == 4 and got[("continuous", 0)].r2 > 0.9 and got[("continuous", 0)].n_train + got[("continuous", 0)].n_test == 120
    assert sc.probe_summary(scores).where("feature_set = 'continuous'").first().mean_r2 > 0.9
    with pytest.raises(ValueError):
        md.run_probes(rows, {"absent": "nope"}, {"t": "y"})


def test_nonlinear_probe_schema(spark):
    _, _, rows = probe_table(spark)
    scores = md.run_probes(rows, {"continuous": "continuous"}, {"t": "y"}, models=("relu",), split_mode="row", n=100)
    assert {r.probe_model for r in scores.collect()} == {"relu"} and scores.count() == 2


def test_unseen_token_gives_zeros(spark):
    from pyspark.ml.functions import vector_to_array

    fit = spark.createDataFrame([([1, 5],), ([2, 5],)], "ids array<bigint>")
    rows = spark.createDataFrame([([2, 5],), ([9, 9],)], "ids array<bigint>")
    got = md.one_hot(rows, fit, "ids", 2, "h").select(vector_to_array("h").alias("h")).collect()
    assert [r.h for r in got] == [[0.0, 1.0, 1.0], [0.0, 0.0, 0.0]]


def test_probe_scores_of_constant_target(spark):
    rows = spark.createDataFrame([("m", "row", "f", "t", 1, 0, 1.0, p) for p in (1.0, 1.0)] + [("m", "row", "f", "t", 1, 1, 1.0, 2.0)],
                                 "probe_model string, split_mode string, feature_set string, target string, n_train bigint, action_dim bigint, y double, p double")
    assert {r.action_dim: r.r2 for r in sc.probe_scores(rows).collect()} == {0: 1.0, 1: 0.0}


def test_probe_summary_mean(spark):
    rows = spark.createDataFrame([("ridge", "row", "f", "t", 0.4, 1.0), ("ridge", "row", "f", "t", 0.6, 3.0)],
                                 "probe_model string, split_mode string, feature_set string, target string, r2 double, mse double")
    assert sc.probe_summary(rows).first()[4:] == (0.5, 2.0)


def test_components_follow_the_spread(spark):
    rows = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.1 * (i % 3)]) for i in range(50)], "idx bigint, x array<double>")
    got = md.principal_plane(rows, "x", None, "idx", 50, 10, 0)
    assert got.count() == 10
    whole = md.principal_plane(rows, "x", None, "idx", 50, 50, 0).orderBy("idx").collect()
    assert whole[0].x < whole[-1].x and abs(sum(r.x for r in whole)) < 1e-6 and {r.usage_count for r in whole} == {1}
    assert whole[-1].x - whole[0].x == pytest.approx(49 * math.sqrt(5), rel=1e-3)


def test_splits_share_no_episode(spark):
    rows = spark.createDataFrame([(i, i // 8) for i in range(48)], "idx bigint, episode_index bigint")
    got = sp.episode_split(rows, 32, 0.25, 1).collect()
    train, test = ({r.episode_index for r in got if r.side == s} for s in ("train", "test"))
    assert train and test and not train & test and len(got) == 32
    assert sp.episodes_to_budget(rows, 1, 0).count() == 2 and sp.episodes_to_budget(rows, 1000, 0).count() == 6
    with pytest.raises(Exception, match="at least two episodes"):
        sp.episodes_to_budget(rows.where("idx < 8"), 4, 0).collect()
    assert sp.reservoir_sample(rows.withColumn("frame_index", F.col("idx") % 8), 3, "idx", 0).count() == 3
    assert sp.sample_rows(rows, 1000, "idx", 0).count() == 48


def test_slim_export_round_trip(spark, tmp_path):
    from framelens.plans.labeling import backfill_stats, slim_export

    rows = spark.createDataFrame([(5 + i, e, i, [float(i)] * 7, [[float(i)] * 4] * 3, v) for i, (e, v) in enumerate([(0, 1), (0, 0), (1, 1)])],
                                 "idx bigint, episode_index bigint, frame_index bigint, action array<double>, latent array<array<double>>, valid bigint")
    root = str(tmp_path / "root")
    slim_export(rows, {"latent": ("float64", (3, 4))}, root, "d", "latent_labels", 10.0)
    read = datasets.scan_frames(spark, root).orderBy("index").collect()
    assert [r["index"] for r in read] == [5, 6, 7] and read[2]["latent_labels.latent"] == [[2.0] * 4] * 3
    about = datasets.descriptions(spark, [root]).first()
    assert (about.total_episodes, about.total_frames, about.total_tasks, about.splits["train"], about.analysis_only) == (2, 3, 0, "0:2", True)
    assert about.features["latent_labels.latent"].shape == [3, 4]
    with pytest.raises(Exception, match="(?i)exist"):
        slim_export(rows, {"latent": ("float64", (3, 4))}, root, "d", "latent_labels", 10.0)
    with pytest.raises(ValueError):
        slim_export(rows, {}, root + "2", "d", "observation.x", 10.0)
    stats, listed = backfill_stats(root, spark, "latent_labels")
    got = {(r.pos, r.stat): r.value for r in stats.collect()}
    assert got[(0, "mean")] == 1.0 and got[(11, "count")] == 2 and listed.first().stats_feature_names == ["latent_labels.latent"]


def test_checkpoint_paths_with_closing_slashes(spark):
    rows = spark.createDataFrame([("/a/runs/x/checkpoints/000100/",), ("/a//runs/./x/checkpoints/000100/pretrained_model//",)], "p string")
    got = rows.select(*[c.alias(n) for n, c in text.checkpoint_columns(F.col("p"), "wrap").items()]).collect()
    assert [(r.source_checkpoint_id, r.source_checkpoint_step, r.source_run_path) for r in got] == [("x__000100", "000100", "/a/runs/x")] * 2


def test_nearest_codes_far_from_the_origin(spark):
    import numpy as np

    from framelens.operators.codebook import nearest_code

    rng = np.random.default_rng(2)
    codes = 1e6 + rng.uniform(size=(40, 8)) * 1e-3
    codes[7] = codes[3]  # a tie: the lower id wins
    tokens = np.concatenate([1e6 + rng.uniform(size=(60, 8)) * 1e-3, codes[[7, 3]]])
    book = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(codes)], "code_id bigint, code array<double>")
    rows = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(tokens)], "idx bigint, vector array<double>")
    matrix = {r.idx: (r.code_id, r.sq_distance) for r in nearest_code(rows, book, ["idx"]).collect()}
    blocks = {r.idx: (r.code_id, r.sq_distance) for r in nearest_code(rows, book, ["idx"], max_numbers=1, block=8).collect()}
    want = {i: int(((t - codes) ** 2).cumsum(1)[:, -1].argmin()) for i, t in enumerate(tokens)}
    assert {i: c for i, (c, _) in matrix.items()} == {i: c for i, (c, _) in blocks.items()} == want
