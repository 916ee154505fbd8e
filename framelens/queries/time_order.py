"""Queries over time-ordered frames: scans, windows, cutoffs and label joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions import tensors
from framelens.operators import frames as fr
from framelens.operators import labels as lb
from framelens.queries.registry import query, r6
from framelens.sources import tables as T

HORIZON = 10
FUTURE = 10


def wide(df, column, names):
    """Array elements as rounded columns."""
    return df.withColumns({n: r6(F.col(column)[i]) for i, n in enumerate(names)}).drop(column)


@query("scan_valid_latents", """
SELECT idx, pos AS pos, round(e[pos + 1], 6) AS x, ids[pos // 16 + 1] AS token FROM v, range(64) p(pos)""")
def scan_valid_latents(spark, sf):
    rows = fr.valid_rows(T.labeled_frames(spark, sf))
    long = rows.select("idx", "ids", F.posexplode("continuous").alias("pos", "x"))
    return long.select("idx", F.col("pos").cast("bigint").alias("pos"), r6("x").alias("x"),
                       F.expr("ids[pos div 16]").alias("token"))


@query("scan_action_context", "SELECT idx, episode_index, frame_index, valid, a0, a1, a2 FROM frames")
def scan_action_context(spark, sf):
    rows = T.frames(spark, sf).select("idx", "episode_index", "frame_index", "valid", "action")
    return wide(rows, "action", ["a0", "a1", "a2"])


@query("select_episodes", """
SELECT idx, episode_index, frame_index FROM frames
WHERE episode_index IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def select_episodes(spark, sf):
    chosen = T.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("episode_index"))
    return fr.select_episodes(T.frames(spark, sf), chosen).select("idx", "episode_index", "frame_index")


@query("delta_window_source", """
SELECT f.idx, CAST(o.n AS BIGINT) AS offset_frames, o.n / CAST(10 AS DOUBLE) AS offset_seconds, g.a0 AS value,
       CAST(CASE WHEN g.idx IS NULL THEN 1 ELSE 0 END AS BIGINT) AS is_pad
FROM frames f CROSS JOIN (VALUES (-10), (-1), (0), (1), (10)) o(n)
LEFT JOIN frames g ON g.episode_index = f.episode_index AND g.frame_index = f.frame_index + o.n""")
def delta_window_source(spark, sf):
    offsets = [-10, -1, 0, 1, 10]
    rows = fr.window_values(T.frames(spark, sf), "action", offsets)
    entries = F.arrays_zip(F.array(*[F.lit(n) for n in offsets]).alias("n"), F.col("window"), F.col("is_pad"))
    return rows.select("idx", F.explode(entries).alias("w")).select(
        "idx", F.col("w.n").cast("bigint").alias("offset_frames"), (F.col("w.n") / T.FPS).alias("offset_seconds"),
        F.get("w.window", F.lit(0)).alias("value"), F.col("w.is_pad").cast("bigint").alias("is_pad"))


@query("passthrough_projection", """
SELECT idx AS "index", episode_index, task_index, frame_index, "timestamp", a0, a1, a2 FROM frames""")
def passthrough_projection(spark, sf):
    from framelens.sources.datasets import passthrough

    source = T.frames(spark, sf).withColumnRenamed("idx", "index")
    return wide(passthrough(source), "action", ["a0", "a1", "a2"])


@query("rename_features", """
SELECT idx AS row_address, episode_index AS episode, valid AS "latent_labels.valid" FROM frames""")
def rename_features(spark, sf):
    from framelens.sources.datasets import rename

    rows = T.frames(spark, sf).select("idx", "episode_index", "valid")
    return rename(rows, {"idx": "row_address", "episode_index": "episode", "valid": "latent_labels.valid"})


@query("expand_compact_labels", """
SELECT idx, valid, CASE WHEN valid = 1 THEN round(e[1], 6) ELSE -1.0 END AS x0,
       CASE WHEN valid = 1 THEN ids[1] ELSE -1 END AS token0 FROM lf""")
def expand_compact_labels(spark, sf):
    rows = T.labeled_frames(spark, sf)
    compact = fr.valid_rows(rows).select("idx", r6(F.col("continuous")[0]).alias("x0"), F.col("ids")[0].alias("token0"))
    full = lb.expand_compact(T.frames(spark, sf), compact, {"x0": F.lit(-1.0), "token0": F.lit(-1).cast("bigint")})
    return full.select("idx", "valid", "x0", "token0")


@query("joint_valid_filter", """
, p AS (SELECT idx, frame_index >= 10 AS past_ok, frame_index + 10 < episode_len AS future_ok FROM frames)
SELECT CAST(count(*) FILTER (past_ok AND future_ok) AS BIGINT) AS jointly_valid,
       CAST(0 AS BIGINT) AS disagreeing_rows, count(*) AS n_rows FROM p""")
def joint_valid_filter(spark, sf):
    pairs = fr.past_future_pairs(T.labeled_frames(spark, sf), "continuous", 10)
    ids = fr.past_future_pairs(T.labeled_frames(spark, sf), "ids", 10)
    masks = pairs.select("idx", (F.col("past_valid") & F.col("future_valid")).alias("continuous_mask")).join(
        ids.select("idx", (F.col("past_valid") & F.col("future_valid")).alias("ids_mask")), "idx")
    return lb.mask_disagreements(masks, ["continuous_mask", "ids_mask"])


@query("reshape_latents", """
SELECT vec_id, CAST(s AS BIGINT) AS slot, CAST(d AS BIGINT) AS dim, round(e[16*s + d + 1], 6) AS x, CAST(64 AS BIGINT) AS flat_size,
       CAST(1 AS BIGINT) AS scalar_size
FROM lat, range(4) a(s), range(16) b(d)""")
def reshape_latents(spark, sf):
    rows = T.latents(spark, sf).select(
        "vec_id", "slots", F.size(tensors.flatten_tensor(F.col("slots"), 3)).cast("bigint").alias("flat_size"),
        F.size(tensors.flatten_tensor(F.col("label"), 1)).cast("bigint").alias("scalar_size"))
    slots = rows.select("vec_id", "flat_size", "scalar_size", F.posexplode("slots").alias("slot", "row"))
    return slots.select("vec_id", "flat_size", "scalar_size", F.col("slot").cast("bigint").alias("slot"),
                        F.posexplode("row").alias("dim", "x")).withColumn(
        "dim", F.col("dim").cast("bigint")).withColumn("x", r6("x"))


@query("label_contract_check", """
SELECT episode_index, CAST(sum(valid) AS BIGINT) AS n_valid, CAST(sum(CASE WHEN label < 9 THEN 1 ELSE 0 END) AS BIGINT) AS n_labels,
       CAST(sum(CASE WHEN label < 9 AND valid <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS stray_labels,
       CAST(sum(CASE WHEN label >= 9 AND valid = 1 THEN 1 ELSE 0 END) AS BIGINT) AS missing_labels
FROM lf GROUP BY episode_index""")
def label_contract_check(spark, sf):
    rows = T.labeled_frames(spark, sf)
    return lb.contract_violations(rows, rows.where("label < 9"))


@query("valid_prefix_check", """
, c AS (SELECT conv_id AS episode_index, turn, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS valid FROM conversations),
n AS (SELECT *, lag(valid) OVER (PARTITION BY episode_index ORDER BY turn) AS prev FROM c)
SELECT 'frames' AS source, episode_index, CAST(0 AS BIGINT) AS violations, CAST(sum(valid) AS BIGINT) AS n_valid, count(*) AS n_rows
FROM frames GROUP BY episode_index
UNION ALL
SELECT 'turns', episode_index, CAST(sum(CASE WHEN valid = 1 AND prev = 0 THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(valid) AS BIGINT), count(*)
FROM n GROUP BY episode_index""")
def valid_prefix_check(spark, sf):
    turns = T.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("episode_index"), F.col("turn").alias("frame_index"),
        F.when(F.col("role") == "assistant", 1).otherwise(0).cast("bigint").alias("valid"))
    a = fr.prefix_violations(T.frames(spark, sf)).withColumn("source", F.lit("frames"))
    return a.unionByName(fr.prefix_violations(turns).withColumn("source", F.lit("turns")))


@query("alignment_check", """
SELECT CAST(count(*) FILTER (valid = 1 AND label < 9) AS BIGINT) AS matched,
       CAST(count(*) FILTER (valid = 1 AND label >= 9) AS BIGINT) AS left_only,
       CAST(count(*) FILTER (valid <> 1 AND label < 9) AS BIGINT) AS right_only FROM lf""")
def alignment_check(spark, sf):
    rows = T.labeled_frames(spark, sf)
    return lb.alignment_report(fr.valid_rows(rows), rows.where("label < 9"), "idx")


@query("plan_cast", """
SELECT vec_id, CAST(p AS BIGINT) AS pos, round(CAST(CAST(e[p + 1] AS FLOAT) AS DOUBLE), 6) AS x,
       CAST(ids[p // 16 + 1] AS BIGINT) AS token FROM lat, range(64) r(p)""")
def plan_cast(spark, sf):
    rows = T.latents(spark, sf).select("vec_id", "continuous", "ids")
    cast = lb.cast_to_plan(rows, {"continuous": ("array<float>", 64), "ids": ("array<bigint>", 4)})
    return cast.select("vec_id", "ids", F.posexplode("continuous").alias("p", "x")).select(
        "vec_id", F.col("p").cast("bigint").alias("pos"), r6(F.col("x").cast("double")).alias("x"),
        F.expr("ids[p div 16]").alias("token"))


@query("scatter_labels_join", """
SELECT idx, CASE WHEN label < 5 THEN round(e[1], 6) ELSE -1.0 END AS x0,
       CAST(CASE WHEN label < 5 THEN 1 ELSE 0 END AS BIGINT) AS valid FROM lf""")
def scatter_labels_join(spark, sf):
    labels = T.labeled_frames(spark, sf).where("label < 5").select("idx", r6(F.col("continuous")[0]).alias("x0"))
    return lb.scatter_labels(T.frames(spark, sf), labels, {"x0": F.lit(-1.0)}).select("idx", "x0", "valid")


@query("past_future_aligned_join", """
SELECT f.idx, f.episode_index, p.a0 AS past_value, n.a0 AS future_value
FROM frames f JOIN frames p ON p.episode_index = f.episode_index AND p.frame_index = f.frame_index - 10
JOIN frames n ON n.episode_index = f.episode_index AND n.frame_index = f.frame_index + 10""")
def past_future_aligned_join(spark, sf):
    rows = T.frames(spark, sf)
    past = fr.window_values(rows, "action", [-10]).where(~F.col("is_pad")[0]).select(
        "idx", "episode_index", F.col("window")[0][0].alias("past_value"))
    future = fr.window_values(rows, "action", [10]).where(~F.col("is_pad")[0]).select(
        "idx", "episode_index", F.col("window")[0][0].alias("future_value"))
    return lb.aligned_pairs(past, future)


@query("past_future_mismatches", """
SELECT idx, CASE WHEN frame_index >= 10 THEN episode_index ELSE -1 END AS past_episode,
       CASE WHEN frame_index + 10 < episode_len THEN episode_index ELSE -1 END AS future_episode, 'index' AS mismatch
FROM frames WHERE (frame_index >= 10) <> (frame_index + 10 < episode_len)""")
def past_future_mismatches(spark, sf):
    rows = T.frames(spark, sf)
    out = lb.pairing_mismatches(rows.where("frame_index >= 10"), rows.where("frame_index + 10 < episode_len"))
    return out.fillna(-1, ["past_episode", "future_episode"])


@query("episode_group_override_join", """
SELECT f.idx, f.episode_index, CASE WHEN c.c_custkey IS NOT NULL THEN 'constant' ELSE 'uniform' END AS mode,
       CASE WHEN c.c_custkey IS NOT NULL THEN CAST(c.c_nationkey AS DOUBLE) ELSE 0.5 END AS constant_value
FROM frames f LEFT JOIN customer c ON c.c_custkey = f.episode_index AND c.c_acctbal > 5000""")
def episode_group_override_join(spark, sf):
    groups = T.table(spark, sf, "customer").where("c_acctbal > 5000").select(
        F.col("c_custkey").alias("episode_index"), F.lit("constant").alias("mode"),
        F.col("c_nationkey").cast("double").alias("constant_value"))
    rows = lb.override_by_episode(T.frames(spark, sf), groups, {"mode": F.lit("uniform"), "constant_value": F.lit(0.5)})
    return rows.select("idx", "episode_index", "mode", "constant_value")


@query("episode_semi_join", """
, pick AS (SELECT DISTINCT conv_id AS ep FROM conversations WHERE role = 'system')
SELECT idx, CASE WHEN episode_index IN (SELECT ep FROM pick) THEN 'test' ELSE 'train' END AS side FROM frames
WHERE episode_index IN (SELECT conv_id FROM conversations)""")
def episode_semi_join(spark, sf):
    talks = T.table(spark, sf, "conversations").withColumnRenamed("conv_id", "episode_index")
    chosen = fr.select_episodes(T.frames(spark, sf), talks.select("episode_index").distinct())
    test_episodes = talks.where("role = 'system'").select("episode_index").distinct()
    test = fr.select_episodes(chosen, test_episodes).select("idx", F.lit("test").alias("side"))
    return test.unionByName(fr.except_episodes(chosen, test_episodes).select("idx", F.lit("train").alias("side")))


@query("valid_counts", "SELECT valid, count(*) AS n_rows FROM frames GROUP BY valid")
def valid_counts(spark, sf):
    return fr.valid_counts(T.frames(spark, sf))


@query("episode_tail_counts", """
, t AS (SELECT episode_index, sum(CASE WHEN valid = 0 THEN 1 ELSE 0 END) AS n FROM frames GROUP BY 1)
SELECT CAST(min(n) AS BIGINT) AS min_tail, median(n) AS median_tail, CAST(max(n) AS BIGINT) AS max_tail,
       array_to_string(list_sort(list(DISTINCT CAST(n AS BIGINT))), ',') AS unique_tails FROM t""")
def episode_tail_counts(spark, sf):
    return fr.tail_summary(T.frames(spark, sf)).withColumn("unique_tails", F.array_join("unique_tails", ","))


@query("dataset_totals", """
SELECT count(DISTINCT episode_index) AS total_episodes, count(DISTINCT task_index) AS total_tasks, count(*) AS total_frames
FROM frames""")
def dataset_totals(spark, sf):
    return fr.dataset_totals(T.frames(spark, sf))


@query("distinct_episodes", "SELECT DISTINCT episode_index FROM frames")
def distinct_episodes(spark, sf):
    return fr.distinct_episodes(T.frames(spark, sf))


@query("episode_ranges", """
WITH o AS (SELECT event_id AS i, user_id AS u, lag(user_id) OVER (ORDER BY event_id) AS p FROM events),
r AS (SELECT i, u, sum(CASE WHEN p IS DISTINCT FROM u THEN 1 ELSE 0 END) OVER (ORDER BY i) AS run FROM o)
SELECT u AS episode_index, min(i) AS "start", max(i) + 1 AS "end" FROM r GROUP BY run, u""", views=False)
def episode_ranges(spark, sf):
    rows = T.table(spark, sf, "events").select(F.col("event_id").alias("row"), F.col("user_id").alias("episode"))
    return fr.contiguous_runs(rows, "row", "episode").withColumnRenamed("episode", "episode_index")


@query("current_action_target", "SELECT idx, episode_index, frame_index, a0, a1, a2 FROM frames WHERE valid = 1")
def current_action_target(spark, sf):
    return wide(fr.current_action(T.frames(spark, sf)), "action", ["a0", "a1", "a2"])


@query("future_action_mean", """
SELECT idx, episode_index, frame_index, round(f0, 6) AS f0, round(f1, 6) AS f1, round(f2, 6) AS f2 FROM fm WHERE valid = 1""")
def future_action_mean(spark, sf):
    rows = fr.future_action_mean(T.frames(spark, sf), FUTURE, 3)
    return wide(rows.select("idx", "episode_index", "frame_index", "future_mean"), "future_mean", ["f0", "f1", "f2"])


@query("action_window_sum", """
SELECT idx, CAST(CASE WHEN count(*) OVER w = 10 THEN 1 ELSE 0 END AS BIGINT) AS label_valid,
       CASE WHEN count(*) OVER w = 10 THEN round(sum(a0) OVER w, 6) END AS s0,
       CASE WHEN count(*) OVER w = 10 THEN round(sum(a1) OVER w, 6) END AS s1,
       CASE WHEN count(*) OVER w = 10 THEN round(sum(a2) OVER w, 6) END AS s2
FROM frames WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)""")
def action_window_sum(spark, sf):
    rows = fr.action_window_sum(T.frames(spark, sf), HORIZON, 3)
    return wide(rows.select("idx", "label_valid", "label"), "label", ["s0", "s1", "s2"])


@query("valid_context", "SELECT idx, episode_index, frame_index FROM frames WHERE valid = 1")
def valid_context(spark, sf):
    return fr.valid_rows(T.frames(spark, sf)).select("idx", "episode_index", "frame_index")


@query("progress_context", """
SELECT idx, row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) - 1 AS progress,
       count(*) OVER (PARTITION BY episode_index) AS valid_len FROM frames WHERE valid = 1""")
def progress_context(spark, sf):
    return fr.progress_context(T.frames(spark, sf)).select("idx", "progress", "valid_len")


@query("progress_bins", """
, p AS (SELECT idx, row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) - 1 AS pos,
               count(*) OVER (PARTITION BY episode_index) AS n FROM frames WHERE valid = 1)
SELECT idx, CAST(least(floor(pos / CAST(greatest(n - 1, 1) AS DOUBLE) * 10), 9) AS BIGINT) AS progress_bin FROM p""")
def progress_bins(spark, sf):
    rows = fr.progress_context(T.frames(spark, sf))
    return rows.select("idx", fr.progress_bin(F.col("progress"), F.col("valid_len"), 10).alias("progress_bin"))


@query("cutoff_whole_episode", """
, t AS (SELECT episode_index, sum(valid) AS n FROM frames GROUP BY 1),
c AS (SELECT episode_index, coalesce(sum(n) OVER (ORDER BY episode_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT idx, episode_index, valid FROM frames JOIN c USING (episode_index) WHERE before < 1000""")
def cutoff_whole_episode(spark, sf):
    return fr.cutoff_whole_episode(T.frames(spark, sf), 1000).select("idx", "episode_index", "valid")


@query("cutoff_first_n_valid", """
, r AS (SELECT *, sum(valid) OVER (ORDER BY episode_index, frame_index ROWS UNBOUNDED PRECEDING) AS k FROM frames)
SELECT idx, episode_index, CAST(CASE WHEN valid = 1 AND k <= 1000 THEN 1 ELSE 0 END AS BIGINT) AS valid FROM r""")
def cutoff_first_n_valid(spark, sf):
    return fr.cutoff_first_valid(T.frames(spark, sf), 1000).select("idx", "episode_index", "valid")


@query("past_future_pairs", """
SELECT f.idx, p.a0 AS past_value, f.a0 AS current_value, n.a0 AS future_value,
       p.idx IS NOT NULL AS past_valid, n.idx IS NOT NULL AS future_valid
FROM frames f LEFT JOIN frames p ON p.episode_index = f.episode_index AND p.frame_index = f.frame_index - 10
LEFT JOIN frames n ON n.episode_index = f.episode_index AND n.frame_index = f.frame_index + 10""")
def past_future_pairs(spark, sf):
    rows = fr.past_future_pairs(T.frames(spark, sf), "action", 10)
    return rows.select("idx", F.col("past")[0].alias("past_value"), F.col("current")[0].alias("current_value"),
                       F.col("future")[0].alias("future_value"), "past_valid", "future_valid")


@query("mixed_supervision_union", """
SELECT idx, valid, a0, true AS latent_supervision, false AS action_supervision FROM frames WHERE episode_index % 2 = 0
UNION ALL
SELECT idx, -1, a0, false, true FROM frames WHERE episode_index % 2 = 1""")
def mixed_supervision_union(spark, sf):
    rows = T.frames(spark, sf).withColumn("a0", F.col("action")[0])
    labeled = rows.where("episode_index % 2 = 0").select("idx", "valid", "a0")
    return lb.mixed_supervision(labeled, rows.where("episode_index % 2 = 1").select("idx", "a0")).fillna(-1, ["valid"])


@query("offset_seconds", """
SELECT vec_id, CAST(i AS BIGINT) AS step, i / CAST(20 + vec_id % 10 AS DOUBLE) AS seconds FROM lat, range(10) r(i)""")
def offset_seconds(spark, sf):
    from framelens.functions.tensors import offset_seconds as offsets

    unit = T.table(spark, sf, "embeddings").select("vec_id", F.posexplode(offsets(HORIZON, 1.0)).alias("step", "i"))
    return unit.select("vec_id", F.col("step").cast("bigint").alias("step"),
                       (F.col("i") / (20 + F.col("vec_id") % 10)).alias("seconds"))
