"""Analysis jobs: a labeled dataset in, result tables and a registered manifest out.

Every job takes frame tables (see ``operators.frames``) and writes its tables below one
output folder. Intermediate tables that several reports read are written once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.functions import fixed, tensors, text
from framelens.operators import buckets as bk
from framelens.operators import frames as fr
from framelens.operators import information as inf
from framelens.operators import models as md
from framelens.operators import sampling as sp
from framelens.operators import scores as sc
from framelens.operators import stats as st
from framelens.operators.labelers import BatchFunction, apply_pair_encoder, apply_reconstructor, condition_losses
from framelens.session import written
from framelens.sources import datasets

TARGETS = {"current_action": "action", "future_action_mean": "future_mean"}


@dataclass(frozen=True)
class LatentAnalysis:
    """Parameters of the distribution analysis; row limits are off unless given."""

    action_dim: int
    slots: tuple[int, int]
    future_frames: int = 10
    rounded_decimals: int = 3
    top_sequences: int = 50
    action_bins: int = 16
    progress_bins: int = 10
    bucket_clusters: int = 128
    action_clusters: int = 64
    fit_rows: int | None = None
    shown_rows: int | None = None
    probe_rows: int | None = None
    test_share: float = 0.2
    probe_split: str = "episode"
    probe_models: tuple[str, ...] = ("ridge", "mlp")
    ridge_alpha: float = 1.0
    top_k: int = 20
    seed: int = 0


def valid_frame_table(frames: DataFrame, p: LatentAnalysis) -> DataFrame:
    """One narrow row per valid frame: context, both action targets, ids and their bucket.

    The label tensors stay in the dataset and are read from there.
    """
    narrow = frames.drop("continuous", "codebook_vectors")
    rows = fr.future_action_mean(narrow, p.future_frames, p.action_dim)
    progress = fr.progress_context(frames).select("idx", "progress", "valid_len")
    if "ids" in frames.columns:
        rows = bk.assign_sequence_buckets(rows)
    return rows.join(progress, "idx")


def latent_analysis(frames: DataFrame, out: str, p: LatentAnalysis, manifest: dict[str, Column], registry: str | None = None,
                    force: bool = False) -> dict[str, DataFrame]:
    """Distribution, information, buckets, context, consistency and probes of one dataset.

    ``frames``: idx, episode_index, frame_index, valid, action, continuous (flat), and if the
    dataset has them ids and codebook_vectors (flat). Returns the result tables as written.
    """
    spark = frames.sparkSession
    has_ids, has_codes = "ids" in frames.columns, "codebook_vectors" in frames.columns
    valid = written(spark, valid_frame_table(frames, p))
    labels = fr.valid_rows(frames)
    slots = tensors.reshape(F.col("continuous"), p.slots)
    tables: dict[str, DataFrame] = {
        "valid_counts": fr.valid_counts(frames),
        "episode_tails": fr.tail_summary(frames).withColumn("unique_tails", F.array_join("unique_tails", " ")),
        "action_value_summary": st.numeric_summary(
            valid.select(F.explode(F.array(*[F.struct(F.lit(n).alias("target"), F.col(c).alias("x")) for n, c in TARGETS.items()])).alias("t"))
            .select("t.target", "t.x"), F.col("x"), ["target"]),
    }
    for name in ["continuous", *(["codebook_vectors"] if has_codes else [])]:
        tables[f"{name}_value_summary"] = st.numeric_summary(labels, F.col(name))
        exact = st.unique_rows(labels, F.col(name)).withColumn("kind", F.lit("exact"))
        rounded = st.unique_rows(labels, tensors.round_elements(F.col(name), p.rounded_decimals)).withColumn("kind", F.lit("rounded"))
        tables[f"{name}_unique_rows"] = exact.unionByName(rounded)
        tables[f"{name}_value_histogram"] = st.histogram(labels.select(F.explode(name).alias("x")), [], "x", 120)
        tables[f"{name}_pca_sample"] = md.principal_plane(
            labels, name, "ids" if has_ids else None, "idx", p.fit_rows, p.shown_rows, p.seed)
    tables["continuous_slot_norm_summary"] = st.slot_norm_summary(labels, slots)
    norms = labels.select(F.posexplode(tensors.slot_norms(slots)).alias("slot", "x"))
    tables["continuous_slot_norm_histogram"] = st.histogram(norms, ["slot"], "x", 100)
    if has_ids:
        tables["id_sequence_counts"] = st.sequence_counts(valid).orderBy(F.desc("count"), "sequence")
        tables["id_top_sequences"] = st.top_sequences(valid, p.top_sequences)
        tables["id_position_counts"] = st.position_counts(valid)
        tables["id_sequence_summary"] = st.sequence_summary(valid)
        information = written(spark, inf.action_information(valid, TARGETS, p.action_bins))
        tables["id_action_mutual_information"] = information.orderBy(F.desc("mi"), F.desc("nmi"))

    tables.update(_bucket_reports(valid, labels, p, has_ids))
    features = {"ids_onehot": "ids", "codebook_vectors": "codebook_vectors", "continuous": "continuous"}
    probes = written(spark, md.run_probes(
        valid, features, TARGETS, n=p.probe_rows, test_share=p.test_share, split_mode=p.probe_split, models=p.probe_models,
        alpha=p.ridge_alpha, seed=p.seed, wide=labels))
    tables["action_probe_scores"] = probes
    tables["action_probe_summary"] = sc.probe_summary(probes).orderBy("probe_model", F.desc("mean_r2"), "mean_mse")
    tables["action_probe_best"] = sc.best_probes(sc.probe_summary(probes))

    stored = _write_tables(tables, out, force)
    return _register(stored, out, manifest, registry, _latent_headline(stored))


def _bucket_reports(valid: DataFrame, labels: DataFrame, p: LatentAnalysis, has_ids: bool) -> dict[str, DataFrame]:
    """Bucket, context and consistency reports; all bucketings and targets run in one job each."""
    spark = valid.sparkSession
    latent, tables = [], {}
    if has_ids:
        latent.append(valid.select("idx", F.lit("id_sequence").alias("kind"), "bucket"))
    if p.bucket_clusters > 0:
        assigned, about = md.kmeans_buckets(
            labels.select("idx", "continuous"), "continuous", p.bucket_clusters, p.fit_rows, "idx", p.seed, "cluster_")
        latent.append(assigned.select("idx", F.lit("continuous_kmeans").alias("kind"), "bucket"))
        tables["continuous_kmeans_fit"] = about
    if not latent:
        return tables
    buckets = latent[0] if len(latent) == 1 else latent[0].unionByName(latent[1])
    buckets = written(spark, buckets)
    context = ["idx", "episode_index", "frame_index", "progress", "valid_len", *TARGETS.values()]
    rows = buckets.withColumnRenamed("kind", "feature_set").join(valid.select(*context), "idx")
    by_target = rows.select("feature_set", "bucket", F.explode(F.array(*[
        F.struct(F.lit(n).alias("target"), F.col(c).alias("x")) for n, c in TARGETS.items()])).alias("t")).select(
        "feature_set", "bucket", "t.target", "t.x")
    keys = ["feature_set", "target"]
    stats = written(spark, bk.action_stats(by_target, keys, "x", p.action_dim))
    tables["action_buckets"] = stats
    tables["action_buckets_top"] = bk.top_rows(stats, keys, [F.desc("count"), "bucket"], p.top_k)
    explained = bk.variance_explained(stats, keys, p.action_dim)
    tables["action_bucket_summary"] = explained.withColumns({
        c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
        for c in ("variance_explained_by_dim", "within_bucket_std_by_dim")}).orderBy(
        F.desc("mean_variance_explained"), F.desc("max_bucket_fraction"))
    tables["bucket_context"] = bk.context_stats(rows, ["feature_set"], p.progress_bins)
    tables["bucket_context_summary"] = bk.context_summary(rows, ["feature_set"], p.progress_bins).orderBy(
        F.desc("weighted_mean_episode_coverage"), "weighted_mean_max_episode_fraction")
    if p.action_clusters > 0:
        action = None
        for name, column in TARGETS.items():
            assigned, about = md.kmeans_buckets(
                valid.select("idx", column), column, p.action_clusters, p.fit_rows, "idx", p.seed, "action_cluster_")
            one = assigned.select("idx", F.lit(name).alias("kind"), "bucket")
            action = one if action is None else action.unionByName(one)
            tables[f"{name}_kmeans_fit"] = about
        pairs = written(spark, bk.pair_counts(action, buckets))
        keys = ["action_target", "feature_set"]
        tables["action_to_latent"] = bk.consistency_stats(pairs, keys)
        tables["action_to_latent_summary"] = bk.consistency_summary(pairs, keys).orderBy(
            F.desc("weighted_mean_top_latent_fraction"), "latent_given_action_entropy")
    return tables


def _latent_headline(t: dict[str, DataFrame]) -> DataFrame:
    """One row of selected metrics; a metric of a report that was not made is null."""
    parts = []

    def take(name: str, report: str, keys: list[str], metric: str) -> None:
        if name in t:
            key = F.concat_ws("/", F.lit(report), *keys, F.lit(metric))
            parts.append(t[name].select(key.alias("key"), F.col(metric).cast("double").alias("value")))

    take("action_probe_summary", "probe", ["feature_set", "target"], "mean_r2")
    take("action_probe_summary", "probe", ["feature_set", "target"], "mean_mse")
    take("action_bucket_summary", "bucket", ["feature_set", "target"], "mean_variance_explained")
    take("bucket_context_summary", "context", ["feature_set"], "bucket_episode_nmi")
    take("bucket_context_summary", "context", ["feature_set"], "weighted_mean_episode_coverage")
    for metric in ("weighted_mean_top_latent_fraction", "latent_given_action_entropy", "action_latent_nmi"):
        take("action_to_latent_summary", "consistency", ["action_target", "feature_set"], metric)
    take("id_action_mutual_information", "information", [], "mi")
    take("id_action_mutual_information", "information", [], "nmi")
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    wanted = {
        f"{fs}_{short}_{m}": (f"probe/{feature}/{target}/{m}",)
        for fs, feature in (("continuous", "continuous"), ("id_sequence", "ids_onehot"))
        for short, target in (("current", "current_action"), ("future", "future_action_mean"))
        for m in ("mean_r2", "mean_mse")
    }
    for fs in ("continuous_kmeans", "id_sequence"):
        for short, target in (("current", "current_action"), ("future", "future_action_mean")):
            wanted[f"{fs}_{short}_mean_variance_explained"] = (f"bucket/{fs}/{target}/mean_variance_explained",)
        wanted[f"{fs}_bucket_episode_nmi"] = (f"context/{fs}/bucket_episode_nmi",)
        wanted[f"{fs}_weighted_episode_coverage"] = (f"context/{fs}/weighted_mean_episode_coverage",)
        base = f"consistency/future_action_mean/{fs}"
        wanted[f"future_action_to_{fs}_top_latent_fraction"] = (f"{base}/weighted_mean_top_latent_fraction",)
        wanted[f"future_action_to_{fs}_latent_given_action_entropy"] = (f"{base}/latent_given_action_entropy",)
        wanted[f"future_action_to_{fs}_nmi"] = (f"{base}/action_latent_nmi",)
    wanted["top_mi"], wanted["top_nmi"] = ("information/mi",), ("information/nmi",)
    return sc.headline(long, wanted, ["key"])


def cosine_analysis(frames: DataFrame, feature: str, offset: int, encoders: dict, out: str, manifest: dict[str, Column],
                    max_rows: int | None = None, seed: int = 0, registry: str | None = None, force: bool = False) -> dict[str, DataFrame]:
    """Past/future cosine per row, format and episode.

    An encoder marks a row as invalid by a null; all formats must agree on the valid rows.
    """
    spark = frames.sparkSession
    pairs = fr.past_future_pairs(frames, feature, offset).where("past_valid AND future_valid")
    encoded = apply_pair_encoder(pairs, encoders)
    if max_rows is not None:
        encoded = sp.sample_rows(encoded, max_rows, "idx", seed)
    scores = written(spark, sc.long_scores(encoded, ["idx", "episode_index"], {
        n: F.when(F.col(f"{n}_past").isNotNull() & F.col(f"{n}_future").isNotNull(), tensors.cosine(F.col(f"{n}_past"), F.col(f"{n}_future")))
        for n in encoders}))
    valid = scores.groupBy("idx").agg(F.count("spcfc").alias("n"))
    if (differing := valid.where((F.col("n") > 0) & (F.col("n") < len(encoders))).count()):
        raise ValueError(f"the formats disagree on the validity of {differing} rows")
    scores = scores.where("spcfc IS NOT NULL")
    datasets.write_scores(scores, f"{out}/scores", force)
    tables = {
        "spcfc_summary": sc.cosine_summary(scores).orderBy("latent_format"),
        "spcfc_by_episode": sc.cosine_by_episode(scores).orderBy("latent_format", "episode_index"),
        "spcfc_histogram": st.histogram(scores, ["latent_format"], "spcfc", 120),
    }
    stored = _write_tables(tables, out, force)
    long = stored["spcfc_summary"].unpivot(["latent_format"], ["mean", "median", "p95"], "stat", "value")
    wanted = {f"{n}_{s}": (n, s) for n in encoders for s in ("mean", "median", "p95")}
    return _register(stored, out, manifest, registry, sc.headline(long, wanted, ["latent_format", "stat"]))


def reconstruction_analysis(pairs: DataFrame, function: BatchFunction, out: str, manifest: dict[str, Column],
                            shown: int = 12, seed: int = 0, registry: str | None = None, force: bool = False) -> dict[str, DataFrame]:
    """Errors of user reconstructions per row and format, and a uniform sample of rows to show."""
    spark = pairs.sparkSession
    carry = ["idx", "episode_index", "frame_index"]
    metrics = written(spark, sc.reconstruction_errors(apply_reconstructor(pairs, carry, function), carry, "target"))
    datasets.write_result_table(metrics.orderBy("idx", "latent_format"), f"{out}/per_sample_metrics", True, force)
    titled = sp.reservoir_sample(pairs.select(*carry), shown, "idx", seed).withColumn(
        "title", text.sample_title(F.col("episode_index"), F.col("frame_index"), F.col("idx")))
    stored = _write_tables({"metrics_by_format": sc.reconstruction_summary(metrics), "shown_samples": titled}, out, force)
    long = stored["metrics_by_format"].unpivot(["latent_format"], ["mean_mse", "mean_psnr_db"], "stat", "value")
    wanted = {f"{n}_{s}": (n, s) for n in fixed.FORMAT_REPRESENTATIONS for s in ("mean_mse", "mean_psnr_db")}
    return _register(stored, out, manifest, registry, sc.headline(long, wanted, ["latent_format", "stat"]))


def ablation_analysis(tokens: DataFrame, decoder: BatchFunction, out: str, manifest: dict[str, Column],
                      registry: str | None = None, force: bool = False) -> dict[str, DataFrame]:
    """Decoder losses under the four token conditions, compared with the normal one."""
    spark = tokens.sparkSession
    carry = [c for c in ("idx", "episode_index", "ids") if c in tokens.columns]
    losses = written(spark, condition_losses(tokens, carry, decoder))
    flat = losses.withColumn("id_sequence", tensors.sequence_text(F.col("ids"))).drop("ids") if "ids" in carry else losses
    datasets.write_result_table(flat.orderBy("idx"), f"{out}/per_sample_losses", True, force)
    tables = {"loss_summary": sc.loss_summary(losses), "loss_vs_normal": sc.loss_comparison(losses)}
    by_episode = sc.loss_by_episode(losses)
    if by_episode is not None:
        tables["loss_by_episode"] = by_episode.orderBy("episode_index")
    if "ids" in carry:
        tables["distinct_sequences"] = st.distinct_sequences(losses)
    stored = _write_tables(tables, out, force)
    means = stored["loss_summary"].select("condition", F.lit("mean_loss").alias("stat"), F.col("mean").alias("value"))
    others = stored["loss_vs_normal"].unpivot(["condition"], ["mean_delta_vs_normal", "mean_ratio_vs_normal"], "stat", "value")
    wanted = {f"{c}_mean_loss": (c, "mean_loss") for c in fixed.CONDITION_COLUMNS}
    for c in list(fixed.CONDITION_COLUMNS)[1:]:
        wanted.update({f"{c}_{s}": (c, s) for s in ("mean_delta_vs_normal", "mean_ratio_vs_normal")})
    return _register(stored, out, manifest, registry, sc.headline(means.unionByName(others), wanted, ["condition", "stat"]))


def _write_tables(tables: dict[str, DataFrame], out: str, force: bool) -> dict[str, DataFrame]:
    stored = {}
    for name, table in tables.items():
        datasets.write_result_table(table, f"{out}/{name}", "sample" in name, force)
        stored[name] = table.sparkSession.read.option("header", True).schema(table.schema).csv(f"{out}/{name}")
    return stored


def _register(stored: dict[str, DataFrame], out: str, manifest: dict[str, Column], registry: str | None,
              headline: DataFrame) -> dict[str, DataFrame]:
    """Write the manifest with its headline metrics; append it to the registry if there is one."""
    row = headline.select(F.struct(*headline.columns).alias("headline_metrics")).withColumns(manifest)
    row = row.withColumn("output_path", F.lit(out))
    now = text.utc_text(F.convert_timezone(None, F.lit("UTC"), F.localtimestamp()))
    full = datasets.with_registration(row, F.lit(f"{out}/manifest.json"), F.lit(registry), now)
    full.coalesce(1).write.mode("overwrite").json(f"{out}/manifest.json")
    if registry:
        datasets.register(full, registry)
    return {**stored, "manifest": full}
