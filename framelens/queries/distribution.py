"""Queries for statistics, information and bucket diagnostics of labeled frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions import tensors
from framelens.operators import buckets as bk
from framelens.operators import frames as fr
from framelens.operators import information as inf
from framelens.operators import stats as st
from framelens.queries.registry import SUMMARY_COLUMNS, query, r6, rounded, summary_sql
from framelens.session import written
from framelens.sources import tables as T

BINS, PROGRESS_BINS = 16, 10
TARGETS = {"current_action": "action", "future_action_mean": "future_mean"}


def valid_latents(spark, sf):
    return fr.valid_rows(T.labeled_frames(spark, sf))


STATS_SQL = """
, el AS (SELECT 'continuous' AS feature, p AS pos, e[p + 1] AS x FROM v, range(64) r(p)
         UNION ALL SELECT 'codebook_vectors', p, cbv[p + 1] FROM v, range(8) r(p)),
w AS (SELECT feature, CAST(pos AS BIGINT) AS pos, min(x) AS min, max(x) AS max, avg(x) AS mean, stddev_pop(x) AS std, CAST(count(*) AS DOUBLE) AS count,
      quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.1) AS q10, quantile_cont(x, 0.5) AS q50,
      quantile_cont(x, 0.9) AS q90, quantile_cont(x, 0.99) AS q99 FROM el GROUP BY ALL),
stats AS (SELECT feature, pos, stat, round(value, 6) AS value FROM (UNPIVOT w ON min, max, mean, std, count, q01, q10, q50, q90, q99 INTO NAME stat VALUE value))
"""


@query("float_feature_stats", STATS_SQL + "SELECT * FROM stats")
def float_feature_stats(spark, sf):
    rows = st.feature_stats(valid_latents(spark, sf), {
        "continuous": F.col("continuous"), "codebook_vectors": F.col("codebook_vectors")})
    return rows.withColumn("pos", F.col("pos").cast("bigint")).withColumn("value", r6("value"))


@query("merge_feature_stats", STATS_SQL + """
, old AS (SELECT 'action' AS feature, CAST(0 AS BIGINT) AS pos, 'max' AS stat, max(a0) AS value FROM frames
          UNION ALL SELECT 'continuous', 0, 'max', 99.0)
SELECT * FROM stats UNION ALL SELECT * FROM old WHERE feature <> 'continuous'""")
def merge_feature_stats(spark, sf):
    new = float_feature_stats(spark, sf)
    old = T.frames(spark, sf).select(F.explode(F.array(F.lit("action"), F.lit("continuous"))).alias("feature"), "action")
    old = old.groupBy("feature").agg(F.max(F.col("action")[0]).alias("m")).select(
        "feature", F.lit(0).cast("bigint").alias("pos"), F.lit("max").alias("stat"),
        F.when(F.col("feature") == "action", F.col("m")).otherwise(99.0).alias("value"))
    return st.merge_stats(old, new)


@query("numeric_summary", f"""
, el AS (SELECT 'continuous' AS feature, unnest(e) AS x FROM v UNION ALL SELECT 'codebook_vectors', unnest(cbv) FROM v)
SELECT feature, {summary_sql('x')} FROM el GROUP BY feature""")
def numeric_summary(spark, sf):
    rows = valid_latents(spark, sf).select(F.explode(F.array(
        F.struct(F.lit("continuous").alias("feature"), F.col("continuous").alias("x")),
        F.struct(F.lit("codebook_vectors").alias("feature"), F.col("codebook_vectors").alias("x")))).alias("f"))
    return rounded(st.numeric_summary(rows.select("f.feature", "f.x"), F.col("x"), ["feature"]), *SUMMARY_COLUMNS)


@query("slot_norm_summary", f"""
, n AS (SELECT CAST(s AS BIGINT) AS slot_index, sqrt(list_sum(list_transform(e[16*s+1:16*s+16], lambda x: x * x))) AS norm FROM v, range(4) r(s))
SELECT slot_index, {summary_sql('norm')} FROM n GROUP BY slot_index""")
def slot_norm_summary(spark, sf):
    out = st.slot_norm_summary(valid_latents(spark, sf), F.col("slots"))
    return rounded(out.withColumn("slot_index", F.col("slot_index").cast("bigint")), *SUMMARY_COLUMNS)


UNIQUE = """
SELECT count(*) AS unique_rows, count(*) FILTER (n = 1) AS singleton_rows, max(n) AS max_usage
FROM (SELECT count(*) AS n FROM v GROUP BY {key})"""


@query("exact_unique_rows", UNIQUE.format(key="e"))
def exact_unique_rows(spark, sf):
    return st.unique_rows(valid_latents(spark, sf), F.col("continuous"))


@query("rounded_unique_rows", UNIQUE.format(key="list_transform(e, lambda x: round_even(x * 10, 0) / 10 + 0.0)"))
def rounded_unique_rows(spark, sf):
    return st.unique_rows(valid_latents(spark, sf), tensors.round_elements(F.col("continuous"), 1))


@query("id_sequence_counts", """
SELECT seq AS sequence, count(*) AS count, round(count(*) / CAST((SELECT count(*) FROM v) AS DOUBLE), 6) AS fraction FROM v GROUP BY seq""")
def id_sequence_counts(spark, sf):
    return rounded(st.sequence_counts(valid_latents(spark, sf)), "fraction")


@query("id_position_counts", """
SELECT CAST(p AS BIGINT) AS position, ids[p + 1] AS token_id, count(*) AS count FROM v, range(4) r(p) GROUP BY ALL""")
def id_position_counts(spark, sf):
    return st.position_counts(valid_latents(spark, sf)).withColumn("position", F.col("position").cast("bigint"))


@query("id_sequence_summary", """
, c AS (SELECT seq, count(*) AS n FROM v GROUP BY seq)
SELECT CAST(4 AS BIGINT) AS sequence_length, count(*) AS unique_sequences, count(*) FILTER (n = 1) AS singleton_sequences,
       max(n) AS max_usage, round(avg(n), 6) AS mean_usage, median(n) AS median_usage FROM c""")
def id_sequence_summary(spark, sf):
    return rounded(st.sequence_summary(valid_latents(spark, sf)), "mean_usage")


@query("distinct_id_sequences", "SELECT count(DISTINCT seq) AS distinct_sequences FROM v")
def distinct_id_sequences(spark, sf):
    return st.distinct_sequences(valid_latents(spark, sf))


@query("format_sequence", "SELECT idx, seq AS sequence FROM v")
def format_sequence(spark, sf):
    return valid_latents(spark, sf).select("idx", tensors.sequence_text(F.col("ids")).alias("sequence"))


@query("round_vectors", """
SELECT vec_id, CAST(p AS BIGINT) AS pos, round(round_even(e[p + 1] * 1000, 0) / 1000 + 0.0, 6) AS x FROM lat, range(64) r(p)""")
def round_vectors(spark, sf):
    rows = T.latents(spark, sf).select("vec_id", F.posexplode(tensors.round_elements(F.col("continuous"), 3)).alias("pos", "x"))
    return rows.select("vec_id", F.col("pos").cast("bigint").alias("pos"), (r6("x") + F.lit(0.0)).alias("x"))


@query("l2_norm", """
SELECT vec_id, CAST(s AS BIGINT) AS slot, round(sqrt(list_sum(list_transform(e[16*s+1:16*s+16], lambda x: x * x))), 6) AS slot_norm,
       round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS row_norm FROM lat, range(4) r(s)""")
def l2_norm(spark, sf):
    rows = T.latents(spark, sf).select(
        "vec_id", r6(tensors.l2_norm(F.col("continuous"))).alias("row_norm"),
        F.posexplode(tensors.slot_norms(F.col("slots"))).alias("slot", "slot_norm"))
    return rows.withColumn("slot", F.col("slot").cast("bigint")).withColumn("slot_norm", r6("slot_norm"))


@query("usage_lookup_join", "SELECT idx, count(*) OVER (PARTITION BY seq) AS usage_count FROM v")
def usage_lookup_join(spark, sf):
    return st.usage_of_rows(valid_latents(spark, sf).select("idx", "ids")).select("idx", "usage_count")


@query("clip_and_log", """
, c AS (SELECT seq, count(*) AS n FROM v GROUP BY seq)
SELECT seq AS sequence, round(log10(n), 6) AS log_usage, round(greatest(least(n / CAST(50 AS DOUBLE), 1.0), 0.0), 6) AS clipped FROM c""")
def clip_and_log(spark, sf):
    rows = st.sequence_counts(valid_latents(spark, sf))
    return rows.select("sequence", r6(F.log10("count")).alias("log_usage"),
                       r6(tensors.unit_interval(F.col("count") / 50.0)).alias("clipped"))


@query("histogram", """
, s AS (SELECT 'value' AS kind, CAST(-1 AS BIGINT) AS slot, unnest(e) AS x, 120 AS bins FROM v
  UNION ALL SELECT 'norm', s, sqrt(list_sum(list_transform(e[16*s+1:16*s+16], lambda x: x * x))), 100 FROM v, range(4) r(s)),
m AS (SELECT kind, slot, min(x) AS lo, max(x) AS hi FROM s GROUP BY ALL)
SELECT kind, slot, CAST(least(floor((x - lo) / (hi - lo) * bins), bins - 1) AS BIGINT) AS bin, count(*) AS count
FROM s JOIN m USING (kind, slot) GROUP BY ALL""")
def histogram(spark, sf):
    rows = valid_latents(spark, sf)
    values = st.histogram(rows.select(F.explode("continuous").alias("x")), [], "x", 120).select(
        F.lit("value").alias("kind"), F.lit(-1).cast("bigint").alias("slot"), "bin", "count")
    norms = rows.select(F.posexplode(tensors.slot_norms(F.col("slots"))).alias("slot", "x"))
    return values.unionByName(st.histogram(norms, ["slot"], "x", 100).select(
        F.lit("norm").alias("kind"), F.col("slot").cast("bigint").alias("slot"), "bin", "count"))


@query("top_k_sequences", "SELECT seq AS sequence, count(*) AS count FROM v GROUP BY seq ORDER BY count DESC, seq LIMIT 50")
def top_k_sequences(spark, sf):
    return st.top_sequences(valid_latents(spark, sf), 50).select("sequence", "count")


@query("top_tokens_per_position", """
, c AS (SELECT CAST(p AS BIGINT) AS position, ids[p + 1] AS token_id, count(*) AS count FROM v, range(4) r(p) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY position ORDER BY count DESC, token_id) AS rank FROM c
QUALIFY row_number() OVER (PARTITION BY position ORDER BY count DESC, token_id) <= 20""")
def top_tokens_per_position(spark, sf):
    out = st.top_tokens(valid_latents(spark, sf), 20)
    return out.withColumn("position", F.col("position").cast("bigint")).withColumn("rank", F.col("rank").cast("bigint"))


EDGES_SQL = """
, q AS (SELECT target, dim, list_sort(list_distinct(quantile_cont(y, [%s]))) AS edges FROM tl GROUP BY ALL),
b AS (SELECT t.idx, t.ids, t.seq, t.target, t.dim, CAST(CASE WHEN len(edges) <= 2 THEN 0
             ELSE len(list_filter(edges[2:len(edges)-1], lambda z: z <= y)) END AS BIGINT) AS bin,
             greatest(len(edges) - 1, 1) AS n_bins
      FROM tl t JOIN q USING (target, dim))
""" % ", ".join(f"{i}/16.0::DOUBLE" for i in range(17))


@query("quantile_bins", """
, q AS (SELECT dim, list_sort(list_distinct(quantile_cont(y, [%s]))) AS edges FROM tl WHERE target = 'current_action' GROUP BY dim)
SELECT idx, CAST(dim AS BIGINT) AS dim, CAST(CASE WHEN len(edges) <= 2 THEN 0
         ELSE len(list_filter(edges[2:len(edges)-1], lambda z: z <= y)) END AS BIGINT) AS bin
FROM tl JOIN q USING (dim) WHERE target = 'current_action'""" % ", ".join(f"{i}/16.0::DOUBLE" for i in range(17)))
def quantile_bins(spark, sf):
    rows = fr.valid_rows(T.frames(spark, sf))
    elements = inf.target_elements(rows, {"current_action": "action"}, "idx")
    out = inf.quantile_bins(elements, ["target", "dim"], "y", BINS)
    return out.select("idx", F.col("dim").cast("bigint").alias("dim"), "bin")


MI_SQL = EDGES_SQL + """
, j0 AS (SELECT 'id_sequence' AS feature, seq AS x, target, dim, bin, count(*) AS n FROM b GROUP BY ALL
  UNION ALL SELECT 'id_pos' || p, CAST(ids[p + 1] AS VARCHAR), target, dim, bin, count(*) FROM b, range(4) r(p) GROUP BY ALL),
j AS (SELECT *, sum(n) OVER (PARTITION BY feature, target, dim) AS t, sum(n) OVER (PARTITION BY feature, target, dim, x) AS nx,
             sum(n) OVER (PARTITION BY feature, target, dim, bin) AS ny FROM j0),
mi0 AS (SELECT feature, target, CAST(dim AS BIGINT) AS dim,
        greatest(sum(n / t::DOUBLE * ln(n * t::DOUBLE / (nx * ny::DOUBLE))), 0) AS mi,
        -sum(n / t::DOUBLE * ln(nx / t::DOUBLE)) AS hx, -sum(n / t::DOUBLE * ln(ny / t::DOUBLE)) AS hy FROM j GROUP BY ALL),
mi AS (SELECT feature, target, dim, round(mi, 6) AS mi, round(CASE WHEN hx = 0 AND hy = 0 THEN 1.0 ELSE mi / ((hx + hy) / 2) END, 6) AS nmi FROM mi0)
"""


def information_table(spark, sf):
    out = inf.action_information(T.valid_frames(spark, sf), TARGETS, BINS)
    return rounded(out.withColumn("dim", F.col("dim").cast("bigint")), "mi", "nmi")


@query("mutual_information", MI_SQL + "SELECT * FROM mi")
def mutual_information(spark, sf):
    return information_table(spark, sf)


@query("rank_mutual_information", MI_SQL + "SELECT * FROM mi ORDER BY mi DESC, nmi DESC, feature, target, dim LIMIT 10")
def rank_mutual_information(spark, sf):
    return information_table(spark, sf).orderBy(F.desc("mi"), F.desc("nmi"), "feature", "target", "dim").limit(10)


@query("metric_matrix", MI_SQL + """
SELECT target || '_a' || dim AS row_label, avg(mi) FILTER (feature = 'id_sequence') AS id_sequence,
 avg(mi) FILTER (feature = 'id_pos0') AS id_pos0, avg(mi) FILTER (feature = 'id_pos1') AS id_pos1,
 avg(mi) FILTER (feature = 'id_pos2') AS id_pos2, avg(mi) FILTER (feature = 'id_pos3') AS id_pos3
FROM mi GROUP BY ALL""")
def metric_matrix(spark, sf):
    rows = information_table(spark, sf).withColumn("row_label", F.concat("target", F.lit("_a"), F.col("dim").cast("string")))
    features = ["id_sequence", *[f"id_pos{p}" for p in range(4)]]
    return rows.groupBy("row_label").pivot("feature", features).agg(F.avg("mi"))


@query("entropy_from_counts", """
, c AS (SELECT CAST(p AS BIGINT) AS position, ids[p + 1] AS t, count(*) AS n FROM v, range(4) r(p) GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY position) AS t_n FROM c)
SELECT position, round(greatest(-sum(n / t_n::DOUBLE * ln(n / t_n::DOUBLE)), 0), 6) AS entropy FROM s GROUP BY position""")
def entropy_from_counts(spark, sf):
    counts = st.position_counts(valid_latents(spark, sf))
    return rounded(inf.entropy(counts, ["position"]).withColumn("position", F.col("position").cast("bigint")), "entropy")


# ---- buckets -------------------------------------------------------------------------------

BUCKET_SQL = """
, sb AS (SELECT seq, ids, dense_rank() OVER (ORDER BY ids) - 1 AS bucket, count(*) AS bucket_count FROM v GROUP BY seq, ids),
bv AS (SELECT t.*, sb.bucket FROM vt t JOIN sb USING (seq)),
bl AS (SELECT 'id_sequence' AS feature_set, bucket, idx, episode_index, frame_index, a0, a1, a2, f0, f1, f2 FROM bv
       UNION ALL
       SELECT 'first_token', CAST(ids[1] AS BIGINT), idx, episode_index, frame_index, a0, a1, a2, f0, f1, f2 FROM bv),
bt AS (SELECT feature_set, 'current_action' AS target, bucket, a0 AS x0, a1 AS x1, a2 AS x2 FROM bl
       UNION ALL SELECT feature_set, 'future_action_mean', bucket, f0, f1, f2 FROM bl)
"""


def bucket_rows(spark, sf):
    """Long bucketings of the valid frames: whole id sequences and first tokens."""
    both = F.array(
        F.struct(F.lit("id_sequence").alias("feature_set"), F.col("bucket").alias("bucket")),
        F.struct(F.lit("first_token").alias("feature_set"), F.col("ids")[0].alias("bucket")))
    columns = ["idx", "episode_index", "frame_index", "progress", "valid_len", "action", "future_mean"]
    return T.valid_frames(spark, sf).select(*columns, F.explode(both).alias("b")).select(
        *columns, "b.feature_set", "b.bucket")


def bucket_targets(spark, sf):
    rows = bucket_rows(spark, sf)
    both = F.array(*[F.struct(F.lit(n).alias("target"), F.col(c).alias("x")) for n, c in TARGETS.items()])
    return rows.select("feature_set", "bucket", F.explode(both).alias("t")).select(
        "feature_set", "bucket", "t.target", "t.x")


@query("discrete_buckets", BUCKET_SQL + "SELECT bucket, seq AS bucket_label, bucket_count FROM sb")
def discrete_buckets(spark, sf):
    return bk.sequence_buckets(valid_latents(spark, sf)).select("bucket", "bucket_label", "bucket_count")


STAT_COLUMNS = [f"{s}_a{d}" for s in ("mean", "std") for d in range(3)]
ACTION_STATS_SQL = BUCKET_SQL + """
, ast AS (SELECT feature_set, target, bucket, count(*) AS count,
  avg(x0) AS mean_a0, avg(x1) AS mean_a1, avg(x2) AS mean_a2,
  stddev_pop(x0) AS std_a0, stddev_pop(x1) AS std_a1, stddev_pop(x2) AS std_a2,
  count(*) / CAST(sum(count(*)) OVER (PARTITION BY feature_set, target) AS DOUBLE) AS fraction FROM bt GROUP BY feature_set, target, bucket)
"""
AST_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in [*STAT_COLUMNS, "fraction"])
KEYS = ["feature_set", "target"]


@query("bucket_action_stats", ACTION_STATS_SQL + f"SELECT feature_set, target, bucket, count, {AST_ROUND} FROM ast")
def bucket_action_stats(spark, sf):
    return rounded(bk.action_stats(bucket_targets(spark, sf), KEYS, "x", 3), *STAT_COLUMNS, "fraction")


VE_SQL = ACTION_STATS_SQL + """
, g AS (SELECT feature_set, target, var_pop(x0) AS v0, var_pop(x1) AS v1, var_pop(x2) AS v2, count(*) AS total_rows FROM bt GROUP BY ALL),
ve0 AS (SELECT feature_set, target, any_value(total_rows) AS total_rows, count(*) AS active_buckets, count(*) FILTER (count = 1) AS singleton_buckets,
  max(count) AS max_bucket_usage, max(count) / CAST(any_value(total_rows) AS DOUBLE) AS max_bucket_fraction,
  CASE WHEN any_value(v0) > 1e-12 THEN 1 - sum(std_a0 * std_a0 * count) / any_value(total_rows) / any_value(v0) ELSE 0 END AS e0,
  CASE WHEN any_value(v1) > 1e-12 THEN 1 - sum(std_a1 * std_a1 * count) / any_value(total_rows) / any_value(v1) ELSE 0 END AS e1,
  CASE WHEN any_value(v2) > 1e-12 THEN 1 - sum(std_a2 * std_a2 * count) / any_value(total_rows) / any_value(v2) ELSE 0 END AS e2,
  sum(std_a0 * count) / any_value(total_rows) AS w0, sum(std_a1 * count) / any_value(total_rows) AS w1, sum(std_a2 * count) / any_value(total_rows) AS w2
  FROM ast JOIN g USING (feature_set, target) GROUP BY ALL),
ve AS (SELECT feature_set, target, total_rows, active_buckets, singleton_buckets, max_bucket_usage, round(max_bucket_fraction, 6) AS max_bucket_fraction,
  round((e0 + e1 + e2) / 3, 6) AS mean_variance_explained, round((w0 + w1 + w2) / 3, 6) AS mean_within_bucket_std,
  round(e0, 6) AS explained_a0, round(e1, 6) AS explained_a1, round(e2, 6) AS explained_a2,
  round(w0, 6) AS within_std_a0, round(w1, 6) AS within_std_a1, round(w2, 6) AS within_std_a2 FROM ve0)
"""


def explained_table(spark, sf):
    stats = bk.action_stats(bucket_targets(spark, sf), KEYS, "x", 3)
    out = bk.variance_explained(stats, KEYS, 3)
    for d in range(3):
        out = out.withColumn(f"explained_a{d}", r6(F.col("variance_explained_by_dim")[d]))
        out = out.withColumn(f"within_std_a{d}", r6(F.col("within_bucket_std_by_dim")[d]))
    out = out.drop("variance_explained_by_dim", "within_bucket_std_by_dim")
    return rounded(out, "max_bucket_fraction", "mean_variance_explained", "mean_within_bucket_std")


@query("variance_explained", VE_SQL + "SELECT * FROM ve")
def variance_explained(spark, sf):
    return explained_table(spark, sf)


CONTEXT_SQL = BUCKET_SQL + """
, bp AS (SELECT bl.*, p.progress, p.valid_len FROM bl JOIN (
    SELECT idx, row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) - 1 AS progress,
           count(*) OVER (PARTITION BY episode_index) AS valid_len FROM frames WHERE valid = 1) p USING (idx)),
ec AS (SELECT feature_set, bucket, episode_index, count(*) AS n FROM bp GROUP BY ALL),
es AS (SELECT feature_set, bucket, CAST(sum(n) AS BIGINT) AS count, count(*) AS unique_episodes,
        count(*) / CAST((SELECT count(DISTINCT episode_index) FROM bp) AS DOUBLE) AS episode_coverage,
        max(n) / CAST(sum(n) AS DOUBLE) AS max_episode_fraction,
        exp(-sum(n / CAST(c AS DOUBLE) * ln(n / CAST(c AS DOUBLE)))) AS episode_perplexity
       FROM (SELECT *, sum(n) OVER (PARTITION BY feature_set, bucket) AS c FROM ec) GROUP BY feature_set, bucket),
pc AS (SELECT feature_set, bucket, count(DISTINCT least(floor(progress / CAST(greatest(valid_len - 1, 1) AS DOUBLE) * 10), 9)) / CAST(10 AS DOUBLE) AS progress_bin_coverage FROM bp GROUP BY ALL),
rl0 AS (SELECT *, CASE WHEN lag(episode_index) OVER w = episode_index AND lag(frame_index) OVER w = frame_index - 1 THEN 0 ELSE 1 END AS st
        FROM bp WINDOW w AS (PARTITION BY feature_set, bucket ORDER BY episode_index, frame_index)),
rl1 AS (SELECT *, sum(st) OVER (PARTITION BY feature_set, bucket ORDER BY episode_index, frame_index) AS run FROM rl0),
rl2 AS (SELECT feature_set, bucket, run, count(*) AS len FROM rl1 GROUP BY ALL),
rl AS (SELECT feature_set, bucket, avg(len) AS mean_run_length, max(len) AS max_run_length,
        sum(len - 1) / CAST(greatest(sum(len) - 1, 1) AS DOUBLE) AS adjacent_repeat_fraction FROM rl2 GROUP BY ALL),
cx AS (SELECT es.*, es.count / CAST(sum(es.count) OVER (PARTITION BY feature_set) AS DOUBLE) AS fraction,
        rl.mean_run_length, rl.max_run_length, rl.adjacent_repeat_fraction, pc.progress_bin_coverage
       FROM es JOIN rl USING (feature_set, bucket) JOIN pc USING (feature_set, bucket))
"""
CONTEXT_FLOATS = ["episode_coverage", "max_episode_fraction", "episode_perplexity", "mean_run_length",
                  "adjacent_repeat_fraction", "progress_bin_coverage", "fraction"]


def rsql(*columns):
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@query("bucket_episode_stats", CONTEXT_SQL + f"""
SELECT feature_set, bucket, count, unique_episodes, {rsql('episode_coverage', 'max_episode_fraction', 'episode_perplexity')} FROM es""")
def bucket_episode_stats(spark, sf):
    return rounded(bk.episode_stats(bucket_rows(spark, sf), ["feature_set"]),
                   "episode_coverage", "max_episode_fraction", "episode_perplexity")


@query("bucket_progress_coverage", CONTEXT_SQL + f"SELECT feature_set, bucket, {rsql('progress_bin_coverage')} FROM pc")
def bucket_progress_coverage(spark, sf):
    out = bk.progress_coverage(bucket_rows(spark, sf), ["feature_set"], PROGRESS_BINS)
    return rounded(out, "progress_bin_coverage")


@query("bucket_run_lengths", CONTEXT_SQL + f"""
SELECT feature_set, bucket, max_run_length, {rsql('mean_run_length', 'adjacent_repeat_fraction')} FROM rl""")
def bucket_run_lengths(spark, sf):
    return rounded(bk.run_lengths(bucket_rows(spark, sf), ["feature_set"]), "mean_run_length", "adjacent_repeat_fraction")


SUMMARY_MEANS = list(bk.CONTEXT_MEANS.values())
CONTEXT_SUMMARY_SQL = CONTEXT_SQL + """
, en AS (SELECT *, sum(n) OVER (PARTITION BY feature_set) AS t, sum(n) OVER (PARTITION BY feature_set, bucket) AS nx,
               sum(n) OVER (PARTITION BY feature_set, episode_index) AS ny FROM ec),
em AS (SELECT feature_set, greatest(sum(n / t::DOUBLE * ln(n * t::DOUBLE / (nx * ny::DOUBLE))), 0) AS mi,
       -sum(n / t::DOUBLE * ln(nx / t::DOUBLE)) AS hx, -sum(n / t::DOUBLE * ln(ny / t::DOUBLE)) AS hy FROM en GROUP BY ALL),
cs AS (SELECT feature_set, CAST(sum(count) AS BIGINT) AS total_rows, count(*) AS active_buckets,
  %s, any_value(round(CASE WHEN hx = 0 AND hy = 0 THEN 1.0 ELSE mi / ((hx + hy) / 2) END, 6)) AS bucket_episode_nmi
  FROM cx JOIN em USING (feature_set) GROUP BY feature_set)
""" % ", ".join(f"round(sum({c} * count) / sum(count), 6) AS {a}" for c, a in bk.CONTEXT_MEANS.items())


@query("bucket_context_summary", CONTEXT_SUMMARY_SQL + "SELECT * FROM cs")
def bucket_context_summary(spark, sf):
    out = bk.context_summary(bucket_rows(spark, sf), ["feature_set"], PROGRESS_BINS)
    return rounded(out, *SUMMARY_MEANS, "bucket_episode_nmi")


# action buckets: quantile bins of the first two action dimensions stand for fitted clusters
PAIR_SQL = BUCKET_SQL + """
, ab AS (SELECT idx, 'current_action' AS action_target, CAST(least(floor(a1 / 10), 9) AS BIGINT) AS action_bucket FROM vt
  UNION ALL SELECT idx, 'future_action_mean', CAST(floor(f1 / 5) AS BIGINT) FROM vt),
pr AS (SELECT action_target, feature_set, action_bucket, bucket AS latent_bucket, count(*) AS n FROM ab JOIN bl USING (idx) GROUP BY ALL)
"""


def bucket_pairs(spark, sf):
    """Counted pairs, written once: every consistency statistic reads them several times."""
    latent = bucket_rows(spark, sf).select("idx", F.col("feature_set").alias("kind"), "bucket")
    both = F.array(
        F.struct(F.lit("current_action").alias("kind"),
                 F.least(F.floor(F.col("action")[1] / 10), F.lit(9)).cast("bigint").alias("bucket")),
        F.struct(F.lit("future_action_mean").alias("kind"), F.floor(F.col("future_mean")[1] / 5).cast("bigint").alias("bucket")))
    action = T.valid_frames(spark, sf).select("idx", F.explode(both).alias("b")).select("idx", "b.kind", "b.bucket")
    return written(spark, bk.pair_counts(action, latent))


PAIR_KEYS = ["action_target", "feature_set"]


@query("bucket_pair_cross", PAIR_SQL + "SELECT * FROM pr")
def bucket_pair_cross(spark, sf):
    return bucket_pairs(spark, sf)


CONSISTENCY_SQL = PAIR_SQL + """
, pk AS (SELECT *, sum(n) OVER (PARTITION BY action_target, feature_set, action_bucket) AS c,
   row_number() OVER (PARTITION BY action_target, feature_set, action_bucket ORDER BY n DESC, latent_bucket) AS rk,
   sum(n) OVER (PARTITION BY action_target, feature_set, action_bucket ORDER BY n DESC, latent_bucket) AS cum FROM pr),
co AS (SELECT action_target, feature_set, action_bucket, CAST(any_value(c) AS BIGINT) AS count, count(*) AS active_latent_buckets,
   max(latent_bucket) FILTER (rk = 1) AS top_latent_bucket, max(n) / CAST(any_value(c) AS DOUBLE) AS top_latent_fraction,
   greatest(-sum(n / CAST(c AS DOUBLE) * ln(n / CAST(c AS DOUBLE))), 0) AS latent_entropy,
   exp(greatest(-sum(n / CAST(c AS DOUBLE) * ln(n / CAST(c AS DOUBLE))), 0)) AS latent_perplexity,
   min(rk) FILTER (cum >= ceil(CAST(0.8 AS DOUBLE) * c)) AS latent_buckets_for_80pct_mass FROM pk GROUP BY ALL),
cf AS (SELECT *, count / CAST(sum(count) OVER (PARTITION BY action_target, feature_set) AS DOUBLE) AS fraction FROM co)
"""
CONSISTENCY_FLOATS = ["top_latent_fraction", "latent_entropy", "latent_perplexity", "fraction"]


@query("action_to_latent_stats", CONSISTENCY_SQL + f"""
SELECT action_target, feature_set, action_bucket, count, active_latent_buckets, top_latent_bucket, latent_buckets_for_80pct_mass,
  {rsql(*CONSISTENCY_FLOATS)} FROM cf""")
def action_to_latent_stats(spark, sf):
    return rounded(bk.consistency_stats(bucket_pairs(spark, sf), PAIR_KEYS), *CONSISTENCY_FLOATS)


CONSISTENCY_SUMMARY_SQL = CONSISTENCY_SQL + """
, pi AS (SELECT *, sum(n) OVER (PARTITION BY action_target, feature_set) AS t, sum(n) OVER (PARTITION BY action_target, feature_set, action_bucket) AS nx,
   sum(n) OVER (PARTITION BY action_target, feature_set, latent_bucket) AS ny FROM pr),
pm AS (SELECT action_target, feature_set, greatest(sum(n / t::DOUBLE * ln(n * t::DOUBLE / (nx * ny::DOUBLE))), 0) AS mi,
   -sum(n / t::DOUBLE * ln(nx / t::DOUBLE)) AS hx, -sum(n / t::DOUBLE * ln(ny / t::DOUBLE)) AS hy,
   count(DISTINCT latent_bucket) AS latent_active_buckets FROM pi GROUP BY ALL),
ps AS (SELECT action_target, feature_set, CAST(sum(count) AS BIGINT) AS total_rows, count(*) AS action_active_buckets, %s,
   any_value(round(CASE WHEN hx = 0 AND hy = 0 THEN 1.0 ELSE mi / ((hx + hy) / 2) END, 6)) AS action_latent_nmi,
   any_value(round(greatest(hx - mi, 0), 6)) AS action_given_latent_entropy, any_value(latent_active_buckets) AS latent_active_buckets,
   round(sum(latent_entropy * count) / sum(count), 6) AS latent_given_action_entropy
   FROM cf JOIN pm USING (action_target, feature_set) GROUP BY action_target, feature_set)
""" % ", ".join(f"round(sum({c} * count) / sum(count), 6) AS {a}" for c, a in bk.CONSISTENCY_MEANS.items())


@query("action_to_latent_summary", CONSISTENCY_SUMMARY_SQL + "SELECT * FROM ps")
def action_to_latent_summary(spark, sf):
    out = bk.consistency_summary(bucket_pairs(spark, sf), PAIR_KEYS)
    return rounded(out, *bk.CONSISTENCY_MEANS.values(), "action_latent_nmi", "action_given_latent_entropy",
                   "latent_given_action_entropy")


@query("bucket_report_fanout", VE_SQL + CONTEXT_SUMMARY_SQL[len(BUCKET_SQL):] + CONSISTENCY_SUMMARY_SQL[len(BUCKET_SQL):] + """
SELECT 'action_buckets' AS report, feature_set, target, active_buckets AS buckets, mean_variance_explained AS metric FROM ve
UNION ALL SELECT 'bucket_context', feature_set, NULL, active_buckets, bucket_episode_nmi FROM cs
UNION ALL SELECT 'action_to_latent', feature_set, action_target, action_active_buckets, action_latent_nmi FROM ps""")
def bucket_report_fanout(spark, sf):
    a = explained_table(spark, sf).select(F.lit("action_buckets").alias("report"), "feature_set", "target",
                                          F.col("active_buckets").alias("buckets"), F.col("mean_variance_explained").alias("metric"))
    b = bucket_context_summary(spark, sf).select(F.lit("bucket_context").alias("report"), "feature_set",
                                                 F.lit(None).cast("string").alias("target"),
                                                 F.col("active_buckets").alias("buckets"), F.col("bucket_episode_nmi").alias("metric"))
    c = action_to_latent_summary(spark, sf).select(
        F.lit("action_to_latent").alias("report"), "feature_set", F.col("action_target").alias("target"),
        F.col("action_active_buckets").alias("buckets"), F.col("action_latent_nmi").alias("metric"))
    return a.unionByName(b).unionByName(c)


@query("rank_bucket_tables", ACTION_STATS_SQL[:-1] + CONTEXT_SQL[len(BUCKET_SQL):] + CONSISTENCY_SQL[len(BUCKET_SQL):] + """
SELECT 'action_buckets' AS report, feature_set, target, bucket, row_number() OVER (PARTITION BY feature_set, target ORDER BY count DESC, bucket) AS rank FROM ast
QUALIFY rank <= 20
UNION ALL
SELECT 'bucket_context', feature_set, NULL, bucket, row_number() OVER (PARTITION BY feature_set ORDER BY count DESC, round(episode_coverage, 9) DESC, round(max_episode_fraction, 9), bucket) AS rank FROM cx
QUALIFY rank <= 20
UNION ALL
SELECT 'action_to_latent', feature_set, action_target, action_bucket, row_number() OVER (PARTITION BY action_target, feature_set
  ORDER BY round(top_latent_fraction, 9) DESC, round(latent_perplexity, 9), active_latent_buckets, action_bucket) AS rank FROM cf
QUALIFY rank <= 20""")
def rank_bucket_tables(spark, sf):
    a = bk.top_rows(bk.action_stats(bucket_targets(spark, sf), KEYS, "x", 3), KEYS, [F.desc("count"), "bucket"], 20)
    b = bk.top_rows(bk.context_stats(bucket_rows(spark, sf), ["feature_set"], PROGRESS_BINS), ["feature_set"], [
        F.desc("count"), F.desc(F.round("episode_coverage", 9)), F.round("max_episode_fraction", 9), "bucket"], 20)
    c = bk.top_rows(bk.consistency_stats(bucket_pairs(spark, sf), PAIR_KEYS), PAIR_KEYS, [
        F.desc(F.round("top_latent_fraction", 9)), F.round("latent_perplexity", 9), "active_latent_buckets", "action_bucket"], 20)

    def shaped(df, report, target, bucket):
        return df.select(F.lit(report).alias("report"), "feature_set", target.alias("target"), F.col(bucket).alias("bucket"),
                         F.col("rank").cast("bigint").alias("rank"))

    return (shaped(a, "action_buckets", F.col("target"), "bucket")
            .unionByName(shaped(b, "bucket_context", F.lit(None).cast("string"), "bucket"))
            .unionByName(shaped(c, "action_to_latent", F.col("action_target"), "action_bucket")))


@query("top_rows_per_table", ACTION_STATS_SQL + f"""
SELECT feature_set, target, bucket, count, {rsql('fraction')},
       row_number() OVER (PARTITION BY feature_set, target ORDER BY count DESC, bucket) AS rank FROM ast QUALIFY rank <= 20""")
def top_rows_per_table(spark, sf):
    stats = bk.action_stats(bucket_targets(spark, sf), KEYS, "x", 3)
    out = bk.top_rows(stats, KEYS, [F.desc("count"), "bucket"], 20)
    return rounded(out.select("feature_set", "target", "bucket", "count", "fraction", F.col("rank").cast("bigint").alias("rank")), "fraction")
