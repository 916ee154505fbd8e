"""Whole jobs from a stored labeled dataset to registered result tables."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelens.functions import tensors
from framelens.operators import labelers as lab
from framelens.plans import analysis, labeling
from framelens.queries import artifacts, scoring
from framelens.sources import datasets
from framelens.sources import tables as T

SF = "/root/testdata/sf0.001"


def manifest(spark, name):
    return {"artifact_id": F.lit(name), "suite_name": F.lit(name)}


def test_latent_analysis(spark, tmp_path):
    frames = T.labeled_frames(spark, SF).drop("slots", "label", "vec_id")
    p = analysis.LatentAnalysis(action_dim=3, slots=(4, 16), bucket_clusters=4, action_clusters=3, fit_rows=300, shown_rows=50)
    out, registry = str(tmp_path / "out"), str(tmp_path / "registry")
    stored = analysis.latent_analysis(frames, out, p, manifest(spark, "core"), registry)
    n = frames.where("valid = 1").count()
    by_set = stored["action_buckets"].where("target = 'current_action'").groupBy("feature_set").agg(F.sum("count")).collect()
    assert {tuple(r) for r in by_set} == {("id_sequence", n), ("continuous_kmeans", n)}
    assert stored["continuous_pca_sample"].count() == 50
    assert stored["action_probe_scores"].count() == 36
    assert stored["action_to_latent_summary"].count() == 4
    top = stored["id_action_mutual_information"].agg(F.max("mi")).first()[0]
    line = json.loads(spark.read.text(registry).first()[0])
    assert line["artifact_id"] == "core" and line["headline_metrics"]["top_mi"] == pytest.approx(top)
    assert line["headline_metrics"]["continuous_current_mean_r2"] is not None
    with pytest.raises(Exception, match="(?i)exist"):
        analysis._write_tables({"valid_counts": stored["valid_counts"]}, out, False)


def test_cosine_analysis(spark, tmp_path):
    frames = T.labeled_frames(spark, SF)
    out = str(tmp_path / "out")
    stored = analysis.cosine_analysis(
        frames, "continuous", 10, {"continuous": lambda other, current: tensors.difference(current, other)}, out,
        manifest(spark, "cosine"), max_rows=100)
    assert stored["spcfc_summary"].first()["count"] == 100
    assert spark.read.parquet(f"{out}/scores").where("latent_format = 'continuous'").count() == 100
    assert stored["manifest"].first().headline_metrics.continuous_mean == pytest.approx(stored["spcfc_summary"].first()["mean"])


def example_reconstructor(pdf):
    out = scoring.two_reconstructions(pdf)
    keys = pdf.set_index("idx")[["episode_index", "frame_index"]]
    return out.join(keys, on="idx")


def test_reconstruction_and_ablation(spark, tmp_path):
    pairs = scoring.frame_pairs(spark, SF)
    stored = analysis.reconstruction_analysis(pairs, example_reconstructor, str(tmp_path / "rec"), manifest(spark, "rec"))
    assert stored["metrics_by_format"].count() == 2 and stored["shown_samples"].count() == 12
    tokens = pairs.select("idx", "episode_index", "target", "first", *[
        tensors.zeros_like(F.col("first")).alias(c) for c in scoring.fixed.CONDITION_COLUMNS])
    stored = analysis.ablation_analysis(tokens, scoring.linear_decoder, str(tmp_path / "abl"), manifest(spark, "abl"))
    assert {r.mean_ratio_vs_normal for r in stored["loss_vs_normal"].collect()} == {1.0}
    assert stored["manifest"].first().headline_metrics.zeroed_action_tokens_mean_delta_vs_normal == 0.0


def test_label_jobs(spark):
    frames = T.frames(spark, SF)
    n = frames.count()
    windowed = labeling.action_window_labels(frames, 10, 3, max_valid=100)
    assert windowed.count() == n and windowed.agg(F.sum("valid")).first()[0] == 100
    assert windowed.where("valid = 0 AND NOT isnan(label[0])").count() == 0
    groups = spark.createDataFrame([(1, "constant", 7.0, 0.0, 0.0, 0.0, 0.0)],
                                   "episode_index bigint, mode string, constant_value double, mean double, std double, low double, high double")
    base = {"mode": F.lit("gaussian"), **{c: F.lit(v) for c, v in
            {"constant_value": 0.0, "mean": 5.0, "std": 0.0, "low": 0.0, "high": 0.0}.items()}}
    episodes = frames.where("episode_index < 3").select("episode_index").distinct()
    synthetic = labeling.synthetic_label_table(frames, groups, base, (2, 2), 0, episodes)
    assert synthetic.count() == n
    assert {tuple(r) for r in synthetic.where("valid = 1").select("episode_index", F.col("label")[3]).distinct().collect()} == {
        (0, 5.0), (1, 7.0), (2, 5.0)}
    rows = frames.withColumn("a0", F.col("action")[0])
    plan = lab.LabelPlan({"a0": [-1, 0, 10]}, {"change": lab.Representation("array<double>", 2, -9.0)})
    full = labeling.user_labels(rows, plan, artifacts.change_labeler, episodes, 40)
    assert full.count() == n and full.where("valid = 1").count() == 40
    assert full.where("valid = 0").select("change").distinct().first()[0] == [-9.0, -9.0]


def test_labeler_must_return_the_declared_names(spark):
    rows = T.frames(spark, SF).withColumn("a0", F.col("action")[0])
    plan = lab.LabelPlan({"a0": [0, 1]}, {"other": lab.Representation("array<double>", 2, 0.0)})
    with pytest.raises(Exception, match="expected"):
        lab.apply_labeler(rows, plan, lambda pdf: pdf[["idx"]].assign(change=None)).collect()


@pytest.mark.parametrize("change, message", [
    (lambda pdf: pd.concat([pdf, pdf]), "more than once"),
    (lambda pdf: pdf.assign(change=[[1.0]] * len(pdf)), "planned size"),
    (lambda pdf: pdf.assign(idx=pdf.idx + 10_000_000), "no frame"),
])
def test_labels_outside_the_contract_fail(spark, change, message):
    rows = T.frames(spark, SF).withColumn("a0", F.col("action")[0])
    plan = lab.LabelPlan({"a0": [-1, 0, 10]}, {"change": lab.Representation("array<double>", 2, -9.0)})
    with pytest.raises(ValueError, match=message):
        labeling.user_labels(rows, plan, lambda pdf: change(artifacts.change_labeler(pdf)))


def test_formats_must_agree_on_valid_rows(spark, tmp_path):
    frames = T.labeled_frames(spark, SF)
    whole = lambda other, current: tensors.difference(current, other)
    some = lambda other, current: F.when(F.col("idx") % 3 != 0, tensors.difference(current, other))
    with pytest.raises(ValueError, match="disagree"):
        analysis.cosine_analysis(frames, "continuous", 10, {"a": whole, "b": some}, str(tmp_path / "x"), manifest(spark, "cosine"))
    stored = analysis.cosine_analysis(frames, "continuous", 10, {"a": some, "b": some}, str(tmp_path / "y"), manifest(spark, "cosine"))
    assert stored["spcfc_summary"].count() == 2


def test_forbidden_prefix(spark, tmp_path):
    rows = spark.range(1).toDF("idx").withColumn("valid", F.lit(1))
    with pytest.raises(ValueError):
        datasets.write_labeled(rows, rows, {}, "observation.x", str(tmp_path / "x"))
