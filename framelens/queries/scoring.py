"""Queries for cosine, reconstruction and ablation scores and for code lookups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framelens.functions import fixed, tensors, text
from framelens.operators import codebook as cb
from framelens.operators import frames as fr
from framelens.operators import labelers as lab
from framelens.operators import scores as sc
from framelens.queries.registry import SUMMARY_COLUMNS, query, r6, rounded, summary_sql
from framelens.sources import tables as T
from framelens.sources.prepared import prepared

OFFSET = 10
BATCH_ROWS, SEED = 256, 7

PAIRS_SQL = """
, pp AS (SELECT f.idx, f.episode_index,
    list_transform(range(1, 65), lambda i: f.e[i] - p.e[i]) AS cp, list_transform(range(1, 65), lambda i: f.e[i] - n.e[i]) AS cf,
    list_transform(range(1, 9), lambda i: f.cbv[i] - p.cbv[i]) AS vp, list_transform(range(1, 9), lambda i: f.cbv[i] - n.cbv[i]) AS vf
  FROM lf f JOIN lf p ON p.episode_index = f.episode_index AND p.frame_index = f.frame_index - 10
  JOIN lf n ON n.episode_index = f.episode_index AND n.frame_index = f.frame_index + 10),
u AS (SELECT idx, episode_index, 'continuous' AS latent_format, cp AS p, cf AS f FROM pp
  UNION ALL SELECT idx, episode_index, 'codebook_vectors', vp, vf FROM pp),
sc AS (SELECT idx, episode_index, latent_format,
  greatest(least(list_inner_product(p, f) / greatest(sqrt(list_inner_product(p, p)) * sqrt(list_inner_product(f, f)), 1e-12), 1.0), -1.0) AS spcfc FROM u)
"""


def encoded_pairs(spark, sf):
    """Past and future labels per format by the difference encoder."""
    rows = T.labeled_frames(spark, sf).withColumn("both", F.struct("continuous", "codebook_vectors"))
    pairs = fr.past_future_pairs(rows, "both", OFFSET)

    def encoder(name):
        return lambda other, current: tensors.difference(current[name], other[name])

    return lab.apply_pair_encoder(pairs, {n: encoder(n) for n in ("continuous", "codebook_vectors")})


def cosine_scores(spark, sf):
    joint = encoded_pairs(spark, sf).where("past_valid AND future_valid")
    return sc.long_scores(joint, ["idx", "episode_index"], {
        n: tensors.cosine(F.col(f"{n}_past"), F.col(f"{n}_future")) for n in ("continuous", "codebook_vectors")})


def stored_scores(spark, sf):
    return prepared(spark, "cosine_scores", T._inputs(sf), lambda: cosine_scores(spark, sf))


@query("apply_pair_encoder", PAIRS_SQL + """
SELECT idx, round(cp[1], 6) AS past0, round(cf[1], 6) AS future0, round(sqrt(list_inner_product(cp, cp)), 6) AS past_norm,
       round(list_sum(vf), 6) AS code_future_sum FROM pp""")
def apply_pair_encoder(spark, sf):
    rows = encoded_pairs(spark, sf).where("past_valid AND future_valid")
    return rows.select("idx", r6(F.col("continuous_past")[0]).alias("past0"), r6(F.col("continuous_future")[0]).alias("future0"),
                       r6(tensors.l2_norm(F.col("continuous_past"))).alias("past_norm"),
                       r6(tensors.total(F.col("codebook_vectors_future"))).alias("code_future_sum"))


@query("spcfc_cosine", PAIRS_SQL + "SELECT idx, round(spcfc, 6) AS spcfc FROM sc WHERE latent_format = 'continuous'")
def spcfc_cosine(spark, sf):
    rows = encoded_pairs(spark, sf).where("past_valid AND future_valid")
    return rows.select("idx", r6(tensors.cosine(F.col("continuous_past"), F.col("continuous_future"))).alias("spcfc"))


@query("union_score_tables", PAIRS_SQL + "SELECT idx, episode_index, latent_format, round(spcfc, 6) AS spcfc FROM sc")
def union_score_tables(spark, sf):
    return rounded(cosine_scores(spark, sf), "spcfc")


@query("spcfc_summary", PAIRS_SQL + f"SELECT latent_format, {summary_sql('spcfc')} FROM sc GROUP BY latent_format")
def spcfc_summary(spark, sf):
    return rounded(sc.cosine_summary(stored_scores(spark, sf)), *SUMMARY_COLUMNS)


@query("spcfc_by_episode", PAIRS_SQL + """
SELECT latent_format, episode_index, count(*) AS count, round(avg(spcfc), 6) AS mean, round(stddev_samp(spcfc), 6) AS std,
       round(min(spcfc), 6) AS min, round(max(spcfc), 6) AS max, round(median(spcfc), 6) AS median FROM sc GROUP BY ALL""")
def spcfc_by_episode(spark, sf):
    return rounded(sc.cosine_by_episode(stored_scores(spark, sf)), "mean", "std", "min", "max", "median")


# ---- reconstruction ------------------------------------------------------------------------

RECON_SQL = """
, cb AS (SELECT label, list(m ORDER BY p) AS code FROM (SELECT label, p, avg(e[p + 1]) AS m FROM lat, range(64) r(p) GROUP BY ALL) GROUP BY label),
t AS (SELECT f.idx, f.e AS cur, n.e AS tgt, cb.code FROM lf f JOIN lf n ON n.episode_index = f.episode_index AND n.frame_index = f.frame_index + 10
  JOIN cb ON cb.label = f.label),
rc AS (SELECT idx, 'continuous' AS latent_format, tgt, cur AS rec FROM t UNION ALL SELECT idx, 'codebook_vectors', tgt, code FROM t
  UNION ALL SELECT idx, 'ids', tgt, list_transform(tgt, lambda x: 0.0::DOUBLE) FROM t),
rm AS (SELECT idx, latent_format, list_sum(list_transform(range(1, 65), lambda i: (rec[i] - tgt[i]) * (rec[i] - tgt[i]))) / 64 AS mse,
   list_sum(list_transform(range(1, 65), lambda i: abs(rec[i] - tgt[i]))) / 64 AS mae FROM rc),
rq AS (SELECT *, -10 * log10(greatest(mse, 1e-12)) AS psnr_db FROM rm)
"""


def frame_pairs(spark, sf):
    """Frames with their label vector and the one of the frame 10 steps later."""
    rows = T.labeled_frames(spark, sf)
    both = rows.withColumn("both", F.struct("continuous", "label"))
    pairs = fr.past_future_pairs(both, "both", OFFSET).where("future_valid")
    return pairs.select("idx", "episode_index", "frame_index", F.col("current.continuous").alias("first"),
                        F.col("current.label").cast("bigint").alias("code_id"), F.col("future.continuous").alias("target"))


def reconstruction_table(spark, sf):
    rows = cb.with_code_vectors(frame_pairs(spark, sf), T.codebook(spark, sf))
    return sc.reconstruction_metrics(rows, ["idx"], "target", {
        "continuous": F.col("first"), "codebook_vectors": F.col("code"), "ids": tensors.zeros_like(F.col("target"))})


@query("reconstruction_metrics", RECON_SQL + """
SELECT idx, latent_format, round(mse, 6) AS mse, round(mae, 6) AS mae, round(psnr_db, 6) AS psnr_db FROM rq""")
def reconstruction_metrics(spark, sf):
    return rounded(reconstruction_table(spark, sf), "mse", "mae", "psnr_db")


@query("reconstruction_summary", RECON_SQL + """
SELECT latent_format, CASE latent_format WHEN 'ids' THEN 'Reconstruction (IDs)' WHEN 'continuous' THEN 'Reconstruction (Continuous)'
  ELSE 'Reconstruction (Codebook Vectors)' END AS display_name, count(*) AS count, round(avg(mse), 6) AS mean_mse, round(median(mse), 6) AS median_mse,
  round(avg(mae), 6) AS mean_mae, round(median(mae), 6) AS median_mae, round(avg(psnr_db), 6) AS mean_psnr_db, round(median(psnr_db), 6) AS median_psnr_db
FROM rq GROUP BY latent_format""")
def reconstruction_summary(spark, sf):
    stored = prepared(spark, "reconstruction", T._inputs(sf), lambda: reconstruction_table(spark, sf))
    names = [f"{s}_{m}" for s in ("mean", "median") for m in ("mse", "mae", "psnr_db")]
    return rounded(sc.reconstruction_summary(stored), *names)


def two_reconstructions(pdf: pd.DataFrame) -> pd.DataFrame:
    """Example of a user function: the frame itself, and the mean of frame and target."""
    same = pdf[["idx", "target"]].assign(latent_format="continuous", recon=pdf["first"])
    mean = pdf[["idx", "target"]].assign(
        latent_format="codebook_vectors", recon=list((np.stack(pdf["first"]) + np.stack(pdf["target"])) / 2))
    return pd.concat([same, mean])


@query("apply_reconstructor", RECON_SQL + """
, two AS (SELECT idx, 'continuous' AS latent_format, tgt, cur AS rec FROM t
  UNION ALL SELECT idx, 'codebook_vectors', tgt, list_transform(range(1, 65), lambda i: (cur[i] + tgt[i]) / 2) FROM t)
SELECT idx, latent_format, round(list_sum(list_transform(range(1, 65), lambda i: (rec[i] - tgt[i]) * (rec[i] - tgt[i]))) / 64, 6) AS mse,
   round(list_sum(list_transform(range(1, 65), lambda i: abs(rec[i] - tgt[i]))) / 64, 6) AS mae FROM two""")
def apply_reconstructor(spark, sf):
    rows = frame_pairs(spark, sf).select("idx", "first", "target")
    out = sc.reconstruction_errors(lab.apply_reconstructor(rows, ["idx"], two_reconstructions), ["idx"], "target")
    return rounded(out.drop("psnr_db"), "mse", "mae")


# ---- codes and ablation --------------------------------------------------------------------

CODE_SQL = """
, cb AS (SELECT label AS code_id, list(m ORDER BY p) AS code FROM (SELECT label, p, avg(e[p + 1]) AS m FROM lat, range(64) r(p) GROUP BY ALL) GROUP BY label),
dl AS (SELECT f.idx, f.episode_index, list_transform(range(1, 65), lambda i: n.e[i] - f.e[i]) AS delta
  FROM lf f JOIN lf n ON n.episode_index = f.episode_index AND n.frame_index = f.frame_index + 10),
nc AS (SELECT idx, any_value(episode_index) AS episode_index, any_value(delta) AS delta, arg_min(code_id, d) AS code_id, arg_min(code, d) AS code, min(d) AS dist
  FROM (SELECT dl.*, cb.*, list_distance(delta, code) AS d FROM dl, cb) GROUP BY idx),
rk AS (SELECT *, row_number() OVER (PARTITION BY idx // 256 ORDER BY idx) AS place,
   row_number() OVER (PARTITION BY idx // 256 ORDER BY md5(CAST(idx AS VARCHAR) || '|7'), idx) AS drawn FROM nc),
sh AS (SELECT a.*, b.code AS other, b.idx AS donor FROM rk a JOIN rk b ON a.idx // 256 = b.idx // 256 AND a.place = b.drawn),
ls AS (SELECT idx, episode_index, dist * dist / 64 AS loss_normal, dist * dist / 64 AS loss_hard_codebook,
   list_distance(other, delta) ** 2 / 64 AS loss_shuffled_action_tokens, list_inner_product(delta, delta) / 64 AS loss_zeroed_action_tokens FROM sh),
ll AS (SELECT 'normal' AS condition, loss_normal AS loss, loss_normal AS base FROM ls UNION ALL SELECT 'hard_codebook', loss_hard_codebook, loss_normal FROM ls
  UNION ALL SELECT 'shuffled_action_tokens', loss_shuffled_action_tokens, loss_normal FROM ls
  UNION ALL SELECT 'zeroed_action_tokens', loss_zeroed_action_tokens, loss_normal FROM ls),
l9 AS (SELECT condition, round(loss, 9) AS loss, round(base, 9) AS base FROM ll),
ds AS (SELECT * FROM (VALUES %s) d(condition, description))
""" % ", ".join(f"('{k}', '{v}')" for k, v in fixed.CONDITION_DESCRIPTIONS.items())


def found_codes(spark, sf):
    """Label differences over 10 frames with the id of their nearest code; at most one row per frame."""
    rows = frame_pairs(spark, sf).drop("code_id")
    rows = rows.withColumn("vector", tensors.difference(F.col("target"), F.col("first")))
    return cb.nearest_code(rows, T.codebook(spark, sf), ["idx"])


def coded_deltas(spark, sf):
    return cb.with_code_vectors(found_codes(spark, sf), T.codebook(spark, sf))


@query("nearest_codebook_join", CODE_SQL + "SELECT idx, CAST(code_id AS BIGINT) AS code_id, round(dist * dist, 6) AS sq_distance FROM nc")
def nearest_codebook_join(spark, sf):
    return rounded(coded_deltas(spark, sf).select("idx", "code_id", "sq_distance"), "sq_distance")


@query("relaxed_quantization", CODE_SQL + "SELECT idx, round(dist, 6) AS residual_norm, round(dist, 6) AS moved_norm FROM nc")
def relaxed_quantization(spark, sf):
    rows = cb.relaxed(coded_deltas(spark, sf), "vector", "code", "idx", SEED, 64)
    return rows.select("idx", r6(tensors.l2_norm(tensors.difference(F.col("vector"), F.col("code")))).alias("residual_norm"),
                       r6(tensors.l2_norm(tensors.difference(F.col("relaxed"), F.col("vector")))).alias("moved_norm"))


@query("shuffled_control_join", CODE_SQL + "SELECT idx, donor, round(other[1], 6) AS other0 FROM sh")
def shuffled_control_join(spark, sf):
    rows = coded_deltas(spark, sf).select("idx", F.struct("idx", "code").alias("token"))
    out = cb.shuffled_control(rows, "idx", "token", BATCH_ROWS, SEED)
    return out.select("idx", F.col("shuffled.idx").alias("donor"), r6(F.col("shuffled.code")[0]).alias("other0"))


@query("zero_ablation", "SELECT vec_id, CAST(p AS BIGINT) AS pos, CAST(0 AS DOUBLE) AS x FROM lat, range(64) r(p)")
def zero_ablation(spark, sf):
    rows = T.latents(spark, sf).select("vec_id", F.posexplode(tensors.zeros_like(F.col("continuous"))).alias("pos", "x"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def linear_decoder(pdf: pd.DataFrame) -> pd.DataFrame:
    """Example of a user decoder: the first frame plus the action token."""
    first = np.stack(pdf["first"])
    out = pdf[["idx", "episode_index", "target"]].copy()
    for c in fixed.CONDITION_COLUMNS:
        out[c] = list(first + np.stack(pdf[c]))
    return out


def build_losses(spark, sf):
    codes = T.codebook(spark, sf)
    named = found_codes(spark, sf).select("idx", "episode_index", "target", "first", "code_id")
    rows = cb.shuffled_control(named, "idx", "code_id", BATCH_ROWS, SEED)  # only ids change rows; their vectors follow
    rows = cb.with_code_vectors(rows, codes)
    rows = cb.with_code_vectors(rows.drop("code_id"), codes.select(F.col("code_id").alias("shuffled"), F.col("code").alias("other")), name="shuffled")
    rows = rows.withColumn("vector", tensors.difference(F.col("target"), F.col("first")))
    rows = cb.relaxed(rows, "vector", "code", "idx", SEED, 64)
    tokens = rows.select(
        "idx", "episode_index", "target", "first", F.col("relaxed").alias("normal"), F.col("code").alias("hard_codebook"),
        F.col("other").alias("shuffled_action_tokens"), tensors.zeros_like(F.col("code")).alias("zeroed_action_tokens"))
    return lab.condition_losses(tokens, ["idx", "episode_index"], linear_decoder)


def losses(spark, sf):
    return prepared(spark, "losses", T._inputs(sf), lambda: build_losses(spark, sf))


LOSS_COLUMNS = list(fixed.CONDITION_COLUMNS.values())
LOSS_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in LOSS_COLUMNS)


@query("apply_condition_losses", CODE_SQL + f"SELECT idx, episode_index, {LOSS_ROUND} FROM ls")
def apply_condition_losses(spark, sf):
    return rounded(build_losses(spark, sf), *LOSS_COLUMNS)


@query("loss_condition_summary", CODE_SQL + f"""
SELECT condition, any_value(description) AS description, {summary_sql('loss', {'p05': .05, 'median': .5, 'p95': .95})}
FROM ll JOIN ds USING (condition) GROUP BY condition""")
def loss_condition_summary(spark, sf):
    return rounded(sc.loss_summary(losses(spark, sf)), "mean", "std", "min", "max", "p05", "median", "p95")


COMPARED = ["mean_delta_vs_normal", "median_delta_vs_normal", "p95_delta_vs_normal", "mean_ratio_vs_normal", "median_ratio_vs_normal"]


@query("loss_vs_baseline", CODE_SQL + """
SELECT condition, any_value(description) AS description, count(*) AS count, round(avg(loss - base), 6) + 0.0 AS mean_delta_vs_normal,
  round(median(loss - base), 6) + 0.0 AS median_delta_vs_normal, round(quantile_cont(loss - base, 0.95), 6) + 0.0 AS p95_delta_vs_normal,
  round(avg(loss / greatest(base, 1e-12)), 6) AS mean_ratio_vs_normal, round(median(loss / greatest(base, 1e-12)), 6) AS median_ratio_vs_normal,
  round(avg(CASE WHEN loss > base THEN 1.0 ELSE 0.0 END), 6) AS fraction_worse_than_normal,
  round(avg(CASE WHEN loss < base THEN 1.0 ELSE 0.0 END), 6) AS fraction_better_than_normal
FROM l9 JOIN ds USING (condition) WHERE condition <> 'normal' GROUP BY condition""")
def loss_vs_baseline(spark, sf):
    # losses of equal tokens must compare as equal in every engine, so the last digits are cut
    nine = losses(spark, sf).withColumns({c: F.round(c, 9) for c in LOSS_COLUMNS})
    out = rounded(sc.loss_comparison(nine), *COMPARED)
    for c in COMPARED[:3]:
        out = out.withColumn(c, F.col(c) + F.lit(0.0))
    return rounded(out, "fraction_worse_than_normal", "fraction_better_than_normal")


@query("loss_by_episode", CODE_SQL + "SELECT episode_index, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in LOSS_COLUMNS)
       + " FROM ls GROUP BY episode_index")
def loss_by_episode(spark, sf):
    return rounded(sc.loss_by_episode(losses(spark, sf)), *LOSS_COLUMNS)


# ---- shapes and names ----------------------------------------------------------------------


@query("squeeze_single_frame", "SELECT vec_id, CAST(p AS BIGINT) AS pos, round(e[p + 1], 6) AS x FROM lat, range(64) r(p)")
def squeeze_single_frame(spark, sf):
    clip = T.latents(spark, sf).select("vec_id", F.array("continuous").alias("clip"))
    rows = clip.select("vec_id", F.posexplode(tensors.squeeze_time(F.col("clip"))).alias("pos", "x"))
    return rows.select("vec_id", F.col("pos").cast("bigint").alias("pos"), r6("x").alias("x"))


@query("reshape_tokens", """
SELECT vec_id, CAST(t AS BIGINT) AS t, CAST(h AS BIGINT) AS h, CAST(w AS BIGINT) AS w, round(e[((t * 2 + h) * 2 + w) * 8 + 1], 6) AS x0
FROM lat, range(2) a(t), range(2) b(h), range(2) c(w)""")
def reshape_tokens(spark, sf):
    grid = T.latents(spark, sf).select("vec_id", tensors.reshape(F.col("continuous"), (2, 2, 2, 8)).alias("g"))
    rows = grid.select("vec_id", F.posexplode("g").alias("t", "g")).select("vec_id", "t", F.posexplode("g").alias("h", "g"))
    rows = rows.select("vec_id", "t", "h", F.posexplode("g").alias("w", "token"))
    return rows.select("vec_id", *[F.col(c).cast("bigint").alias(c) for c in "thw"], r6(F.col("token")[0]).alias("x0"))


@query("sample_title", """
, p AS (SELECT idx, CASE WHEN idx % 3 <> 0 THEN episode_index END AS ep, CASE WHEN idx % 4 <> 0 THEN frame_index END AS fr, CASE WHEN idx % 2 <> 0 THEN idx END AS ix FROM frames)
SELECT idx, coalesce(nullif(concat_ws(' | ', 'ep ' || ep, 'frame ' || fr, 'idx ' || ix), ''), 'sample') AS title FROM p""")
def sample_title(spark, sf):
    rows = T.frames(spark, sf)
    return rows.select("idx", text.sample_title(
        F.when(F.col("idx") % 3 != 0, F.col("episode_index")), F.when(F.col("idx") % 4 != 0, F.col("frame_index")),
        F.when(F.col("idx") % 2 != 0, F.col("idx"))).alias("title"))


@query("display_name", """
, k AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'ids' WHEN 'view' THEN 'continuous' WHEN 'error' THEN 'codebook_vectors' ELSE event_type END AS f FROM events)
SELECT event_id, f AS latent_format, CASE f WHEN 'ids' THEN 'Reconstruction (IDs)' WHEN 'continuous' THEN 'Reconstruction (Continuous)'
  WHEN 'codebook_vectors' THEN 'Reconstruction (Codebook Vectors)' ELSE f END AS display_name,
  CASE f WHEN 'ids' THEN 'codebook_id_latents' WHEN 'continuous' THEN 'continuous_vector_latents' WHEN 'codebook_vectors' THEN 'codebook_vector_latents' ELSE f END AS representation
FROM k""")
def display_name(spark, sf):
    kind = F.col("event_type")
    f = F.when(kind == "click", "ids").when(kind == "view", "continuous").when(kind == "error", "codebook_vectors").otherwise(kind)
    rows = T.table(spark, sf, "events").select("event_id", f.alias("latent_format"))
    return rows.select("event_id", "latent_format", text.display_name(F.col("latent_format")).alias("display_name"),
                       text.representation_name(F.col("latent_format")).alias("representation"))


@query("order_by_index", PAIRS_SQL + "SELECT idx, latent_format, round(spcfc, 6) AS spcfc FROM sc ORDER BY idx, latent_format")
def order_by_index(spark, sf):
    return rounded(stored_scores(spark, sf).select("idx", "latent_format", "spcfc"), "spcfc").orderBy("idx", "latent_format")
