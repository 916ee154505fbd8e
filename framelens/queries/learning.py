"""Queries for samples, splits, scaling, clusters, components and probes."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from framelens.functions import tensors
from framelens.operators import frames as fr
from framelens.operators import models as md
from framelens.operators import sampling as sp
from framelens.operators import scores as sc
from framelens.operators.ordering import attach
from framelens.queries.registry import query, r6, rounded
from framelens.session import written
from framelens.sources import tables as T

TARGETS = {"current_action": "action", "future_action_mean": "future_mean"}
SHARE = 0.2


def md5(key: str, seed: str) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|{seed}')"


@query("sample_rows_capped", f"SELECT idx, episode_index FROM vt ORDER BY {md5('idx', '3')}, idx LIMIT 500")
def sample_rows_capped(spark, sf):
    return sp.sample_rows(T.valid_frames(spark, sf), 500, "idx", 3).select("idx", "episode_index")


@query("row_split", f"""
, s AS (SELECT idx FROM vt ORDER BY {md5('idx', '5')}, idx LIMIT 2000),
k AS (SELECT idx, row_number() OVER (ORDER BY {md5('idx', '5-split')}, idx) AS rk, count(*) OVER () AS n FROM s)
SELECT idx, CASE WHEN rk <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS side FROM k""")
def row_split(spark, sf):
    return sp.row_split(T.valid_frames(spark, sf), 2000, SHARE, "idx", 5).select("idx", "side")


BUDGET_SQL = f"""
, ec AS (SELECT episode_index, count(*) AS n_rows FROM vt GROUP BY 1),
eo AS (SELECT *, row_number() OVER (ORDER BY {md5('episode_index', '9')}, episode_index) AS rk,
  coalesce(sum(n_rows) OVER (ORDER BY {md5('episode_index', '9')}, episode_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ec),
eb AS (SELECT episode_index, n_rows FROM eo WHERE before < 2000 OR rk <= 2),
es AS (SELECT episode_index, CASE WHEN row_number() OVER (ORDER BY {md5('episode_index', '9-split')}, episode_index) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ())
   THEN 'test' ELSE 'train' END AS side FROM eb)
"""


@query("select_episodes_to_budget", BUDGET_SQL + "SELECT episode_index, n_rows FROM eb")
def select_episodes_to_budget(spark, sf):
    return sp.episodes_to_budget(T.valid_frames(spark, sf), 2000, 9)


@query("episode_split", BUDGET_SQL + "SELECT idx, episode_index, side FROM vt JOIN es USING (episode_index)")
def episode_split(spark, sf):
    """The split of a budget of rows."""
    return sp.episode_split(T.valid_frames(spark, sf), 2000, SHARE, 9).select("idx", "episode_index", "side")


SPLIT_SQL = f"""
, ee AS (SELECT DISTINCT episode_index FROM vt),
es AS (SELECT episode_index, CASE WHEN row_number() OVER (ORDER BY {md5('episode_index', '9-split')}, episode_index) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ())
   THEN 'test' ELSE 'train' END AS side FROM ee)
"""


def split_rows(spark, sf):
    """All valid frames, split by episode."""
    return sp.episode_split(T.valid_frames(spark, sf), None, SHARE, 9)


@query("episode_split_all", SPLIT_SQL + "SELECT idx, episode_index, side FROM vt JOIN es USING (episode_index)")
def episode_split_all(spark, sf):
    return split_rows(spark, sf).select("idx", "episode_index", "side")


@query("reservoir_sample", f"SELECT idx, episode_index, frame_index FROM vt ORDER BY {md5('idx', '11')}, idx LIMIT 12")
def reservoir_sample(spark, sf):
    return sp.reservoir_sample(T.valid_frames(spark, sf), 12, "idx", 11).select("idx", "episode_index", "frame_index")


SCALED = """
SELECT idx, round((a0 - m0) / s0, 6) AS z0, round((a1 - m1) / s1, 6) AS z1, round((a2 - m2) / s2, 6) AS z2 FROM vt, m"""
MOMENTS = "avg(a0) AS m0, avg(a1) AS m1, avg(a2) AS m2, stddev_pop(a0) AS s0, stddev_pop(a1) AS s1, stddev_pop(a2) AS s2"


def scaled(rows, fit_rows):
    out = md.standardize(rows, "action", fit_rows, "z")
    return out.select("idx", *[r6(F.col("z")[d]).alias(f"z{d}") for d in range(3)])


@query("fit_subsample", f"""
, s AS (SELECT * FROM vt ORDER BY {md5('idx', '13')}, idx LIMIT 700), m AS (SELECT {MOMENTS} FROM s) {SCALED}""")
def fit_subsample(spark, sf):
    rows = T.valid_frames(spark, sf)
    return scaled(rows, sp.fit_sample(rows, 700, "idx", 13))


@query("standardize", SPLIT_SQL + f"""
, m AS (SELECT {MOMENTS} FROM vt JOIN es USING (episode_index) WHERE side = 'train') {SCALED}""")
def standardize(spark, sf):
    return scaled(T.valid_frames(spark, sf), split_rows(spark, sf).where("side = 'train'"))


@query("kmeans_latent_buckets")
def kmeans_latent_buckets(spark, sf):
    rows = fr.valid_rows(T.labeled_frames(spark, sf)).select("idx", "continuous")
    assigned, summary = md.kmeans_buckets(rows, "continuous", 16, None, "idx", 0, "cluster_")
    counts = assigned.groupBy("bucket", "bucket_label").agg(F.count("*").alias("bucket_count"))
    return attach(counts, summary, [])


@query("kmeans_action_buckets")
def kmeans_action_buckets(spark, sf):
    out = None
    for target, column in TARGETS.items():
        rows = T.valid_frames(spark, sf).select("idx", column)
        assigned, summary = md.kmeans_buckets(rows, column, 64, None, "idx", 0, "action_cluster_")
        counts = assigned.groupBy("bucket", "bucket_label").agg(F.count("*").alias("bucket_count"))
        one = attach(counts, summary, []).withColumn("action_target", F.lit(target))
        out = one if out is None else out.unionByName(one)
    return out


@query("kmeans_latent_assignment", """
, cb AS (SELECT label AS code_id, list(m ORDER BY p) AS code FROM (SELECT label, p, avg(e[p + 1]) AS m FROM lat, range(64) r(p) GROUP BY ALL) GROUP BY label),
sp AS (SELECT p, avg(e[p + 1]) AS m, stddev_pop(e[p + 1]) AS s FROM v, range(64) r(p) GROUP BY p),
sl AS (SELECT list(m ORDER BY p) AS m, list(s ORDER BY p) AS s FROM sp),
cz AS (SELECT row_number() OVER (ORDER BY code_id) - 1 AS bucket, list_transform(range(1, 65), lambda i: (code[i] - m[i]) / s[i]) AS c FROM cb, sl),
vz AS (SELECT idx, list_transform(range(1, 65), lambda i: (e[i] - m[i]) / s[i]) AS z FROM v, sl),
am AS (SELECT idx, arg_min(bucket, list_distance(z, c)) AS bucket FROM vz, cz GROUP BY idx)
SELECT idx, bucket, 'cluster_' || bucket AS bucket_label FROM am""")
def kmeans_latent_assignment(spark, sf):
    """The assignment of a cluster fit, for given centres: the mean label vectors, scaled like the rows."""
    rows = fr.valid_rows(T.labeled_frames(spark, sf)).select("idx", "continuous")
    m = md.moments(rows, F.col("continuous")).first()["m"]
    place = F.row_number().over(Window.orderBy("code_id")) - 1  # one row per code
    scaled = tensors.standardized(F.col("code"), F.array(*map(F.lit, m["mean"])), F.array(*map(F.lit, m["std"])))
    centres = written(spark, T.codebook(spark, sf).select(place.cast("bigint").alias("code_id"), scaled.alias("code")))
    return md.scaled_clusters(rows, "continuous", centres, m["mean"], m["std"], "cluster_").select("idx", "bucket", "bucket_label")


@query("one_hot_ids", SPLIT_SQL + """
, tr AS (SELECT DISTINCT CAST(p AS BIGINT) AS p, CAST(ids[p + 1] AS VARCHAR) AS token FROM vt JOIN es USING (episode_index), range(4) r(p) WHERE side = 'train'),
vc AS (SELECT p, token, row_number() OVER (ORDER BY p, token) - 1 AS col FROM tr)
SELECT idx, col AS "column" FROM vt, range(4) r(q) JOIN vc ON vc.p = q AND vc.token = CAST(ids[q + 1] AS VARCHAR)""")
def one_hot_ids(spark, sf):
    train = split_rows(spark, sf).where("side = 'train'")
    hot = md.one_hot(T.valid_frames(spark, sf), train, "ids", 4, "hot")
    return hot.select("idx", F.posexplode(vector_to_array("hot")).alias("column", "v")).where("v = 1").select(
        "idx", F.col("column").cast("bigint").alias("column"))


def probes(spark, sf, features, **settings):
    return md.run_probes(T.valid_frames(spark, sf), features, TARGETS, wide=T.labeled_frames(spark, sf), **settings)


FEATURES = {"ids_onehot": "ids", "codebook_vectors": "codebook_vectors", "continuous": "continuous"}


@query("ridge_probe")
def ridge_probe(spark, sf):
    return probes(spark, sf, FEATURES, models=("ridge",))


@query("nonlinear_probe")
def nonlinear_probe(spark, sf):
    return probes(spark, sf, {"continuous": "continuous"}, models=("mlp",))


@query("run_probes")
def run_probes(spark, sf):
    return probes(spark, sf, FEATURES, split_mode="row")


@query("ridge_probe_two_features", SPLIT_SQL + """
, r AS (SELECT vt.*, es.side FROM vt JOIN es USING (episode_index)),
m AS (SELECT avg(a0) AS m0, avg(a1) AS m1, stddev_pop(a0) AS s0, stddev_pop(a1) AS s1 FROM r WHERE side = 'train'),
z AS (SELECT side, (a0 - m0) / s0 AS z0, (a1 - m1) / s1 AS z1, f0, f1, f2 FROM r, m),
g AS (SELECT count(*) AS n, covar_pop(z0, z1) AS c, var_pop(z0) AS v0, var_pop(z1) AS v1, avg(f0) AS y0, avg(f1) AS y1, avg(f2) AS y2,
  covar_pop(z0, f0) AS p00, covar_pop(z1, f0) AS p10, covar_pop(z0, f1) AS p01, covar_pop(z1, f1) AS p11, covar_pop(z0, f2) AS p02, covar_pop(z1, f2) AS p12
  FROM z WHERE side = 'train'),
h AS (SELECT *, (n * v0 + 1) AS q00, (n * v1 + 1) AS q11, n * c AS q01 FROM g),
w AS (SELECT *, q00 * q11 - q01 * q01 AS det FROM h),
l AS (SELECT CAST(d AS BIGINT) AS action_dim, n, [f0, f1, f2][d + 1] AS y,
   [y0, y1, y2][d + 1] + z0 * (q11 * n * [p00, p01, p02][d + 1] - q01 * n * [p10, p11, p12][d + 1]) / det
     + z1 * (q00 * n * [p10, p11, p12][d + 1] - q01 * n * [p00, p01, p02][d + 1]) / det AS p
   FROM z, w, range(3) t(d) WHERE side = 'test'),
s AS (SELECT action_dim, any_value(n) AS n_train, count(*) AS n_test, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, avg((y - p) ** 2) AS mse FROM l GROUP BY 1)
SELECT action_dim, n_train, n_test, round(r2, 6) AS r2, round(mse, 6) AS mse FROM s""")
def ridge_probe_two_features(spark, sf):
    """The ridge fit on the first two action dimensions, small enough for a closed form in SQL."""
    split = written(spark, split_rows(spark, sf).select("idx", "side", "future_mean", F.slice("action", 1, 2).alias("pair")))
    out = md.fit_probe(split, "pair", "pair", {"future_action_mean": "future_mean"}, "episode", "ridge", 1.0)
    return rounded(out.select("action_dim", "n_train", "n_test", "r2", "mse"), "r2", "mse")


# ---- scoring of given predictions ----------------------------------------------------------

PREDICTIONS_SQL = SPLIT_SQL + """
, r AS (SELECT vt.*, es.side FROM vt JOIN es USING (episode_index)),
b AS (SELECT 'action' AS feature_set, 'future_action_mean' AS target, [f0, f1, f2] AS y, [a0, a1, a2] AS x FROM r WHERE side = 'test'
   UNION ALL SELECT 'future', 'current_action', [a0, a1, a2], [f0, f1, f2] FROM r WHERE side = 'test'),
pr AS (SELECT 'persistence' AS probe_model, feature_set, target, CAST(d AS BIGINT) AS action_dim, y[d + 1] AS y, x[d + 1] AS p FROM b, range(3) t(d)
   UNION ALL SELECT 'half', feature_set, target, d, y[d + 1], x[d + 1] / 2 FROM b, range(3) t(d)),
ps0 AS (SELECT probe_model, 'episode' AS split_mode, feature_set, target, (SELECT count(*) FROM r WHERE side = 'train') AS n_train, action_dim,
   count(*) AS n_test, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, avg((y - p) ** 2) AS mse FROM pr GROUP BY ALL),
ps AS (SELECT *, avg(r2) OVER w AS avg_r2_for_target, avg(mse) OVER w AS avg_mse_for_target FROM ps0 WINDOW w AS (PARTITION BY probe_model, feature_set, target)),
pm AS (SELECT probe_model, split_mode, feature_set, target, round(avg(r2), 9) AS mean_r2, round(avg(mse), 9) AS mean_mse FROM ps GROUP BY ALL)
"""


def prediction_scores(spark, sf):
    """Scores of two fixed predictors on the held-out rows: the other target, and half of it."""
    split = written(spark, split_rows(spark, sf).select("side", "action", "future_mean"))
    n_train = split.where("side = 'train'").agg(F.count("*")).scalar()
    test = split.where("side = 'test'")
    both = F.array(
        F.struct(F.lit("action").alias("feature_set"), F.lit("future_action_mean").alias("target"),
                 F.col("future_mean").alias("y"), F.col("action").alias("x")),
        F.struct(F.lit("future").alias("feature_set"), F.lit("current_action").alias("target"),
                 F.col("action").alias("y"), F.col("future_mean").alias("x")))
    long = test.select(F.explode(both).alias("b")).select(
        "b.feature_set", "b.target", F.posexplode(F.arrays_zip(F.col("b.y").alias("y"), F.col("b.x").alias("x"))).alias("action_dim", "z"))

    def predicted(model, share):
        return long.select(
            F.lit(model).alias("probe_model"), F.lit("episode").alias("split_mode"), "feature_set", "target",
            n_train.alias("n_train"), F.col("action_dim").cast("bigint").alias("action_dim"),
            F.col("z.y").alias("y"), (F.col("z.x") * share).alias("p"))

    return sc.probe_scores(predicted("persistence", 1.0)), sc.probe_scores(predicted("half", 0.5))


SCORES = ["r2", "mse", "avg_r2_for_target", "avg_mse_for_target"]
SCORES_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in SCORES)


@query("probe_scores", PREDICTIONS_SQL + f"""
SELECT probe_model, split_mode, feature_set, target, n_train, action_dim, n_test, {SCORES_SQL} FROM ps WHERE probe_model = 'persistence'""")
def probe_scores(spark, sf):
    return rounded(prediction_scores(spark, sf)[0], *SCORES)


@query("union_probe_tables", PREDICTIONS_SQL + f"""
SELECT probe_model, split_mode, feature_set, target, n_train, action_dim, n_test, {SCORES_SQL} FROM ps""")
def union_probe_tables(spark, sf):
    return rounded(sc.union_probes(*prediction_scores(spark, sf)), *SCORES)


@query("probe_score_summary", PREDICTIONS_SQL + """
SELECT probe_model, split_mode, feature_set, target, round(mean_r2, 6) AS mean_r2, round(mean_mse, 6) AS mean_mse FROM pm""")
def probe_score_summary(spark, sf):
    table = sc.probe_summary(sc.union_probes(*prediction_scores(spark, sf)))
    return rounded(table.withColumns({c: F.round(c, 9) for c in ("mean_r2", "mean_mse")}), "mean_r2", "mean_mse")


@query("best_probe_per_model", PREDICTIONS_SQL + """
, br AS (SELECT * FROM pm QUALIFY row_number() OVER (PARTITION BY probe_model ORDER BY mean_r2 DESC, mean_mse) = 1),
bm AS (SELECT * FROM pm QUALIFY row_number() OVER (PARTITION BY probe_model ORDER BY mean_mse, mean_r2 DESC) = 1)
SELECT br.probe_model, br.split_mode, br.feature_set AS best_r2_feature_set, br.target AS best_r2_target, round(br.mean_r2, 6) AS best_mean_r2,
  bm.feature_set AS best_mse_feature_set, bm.target AS best_mse_target, round(bm.mean_mse, 6) AS best_mean_mse FROM br JOIN bm USING (probe_model)""")
def best_probe_per_model(spark, sf):
    table = sc.probe_summary(sc.union_probes(*prediction_scores(spark, sf)))
    # equal errors must tie in every engine, so the last digits are cut before ranking
    table = table.withColumns({c: F.round(c, 9) for c in ("mean_r2", "mean_mse")})
    return rounded(sc.best_probes(table), "best_mean_r2", "best_mean_mse")


@query("pca_scatter_table")
def pca_scatter_table(spark, sf):
    rows = fr.valid_rows(T.labeled_frames(spark, sf)).select("idx", "ids", "continuous")
    return md.principal_plane(rows, "continuous", "ids", "idx", None, None, 0)
