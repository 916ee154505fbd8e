"""Queries for dataset folders, catalogs, manifests, names and label specifications."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framelens.functions import fixed, text
from framelens.operators import catalog as ct
from framelens.operators import frames as fr
from framelens.operators import labelers as lab
from framelens.operators import labels as lb
from framelens.operators import states as st
from framelens.plans import labeling
from framelens.queries import distribution as ds
from framelens.queries.registry import query, r6, rounded
from framelens.queries.scoring import cosine_scores, losses, PAIRS_SQL
from framelens.operators.scores import headline
from framelens.session import shared_folder, written
from framelens.sources import datasets, frame_files
from framelens.sources import registry as artifact_registry
from framelens.sources import tables as T

PREFIX = fixed.DEFAULT_LABEL_PREFIX
PARITIES = ("even", "odd")


def slim_roots(spark, sf):
    """Two exported datasets: the frames of even and of odd episodes."""
    rows = T.labeled_frames(spark, sf)
    roots = []
    for i, name in enumerate(PARITIES):
        root = f"{shared_folder(spark)}/{name}"
        labeling.slim_export(rows.where(F.col("episode_index") % 2 == i), {
            "continuous": ("float64", (64,)), "ids": ("int64", (4,))}, root, name, PREFIX, T.FPS)
        roots.append(root)
    return roots


FEATURES_SQL = """
, ft AS (SELECT * FROM (VALUES ('index','int64','1'), ('episode_index','int64','1'), ('task_index','int64','1'), ('frame_index','int64','1'),
  ('timestamp','float64','1'), ('action','float64','3'), ('latent_labels.continuous','float64','64'), ('latent_labels.ids','int64','4'),
  ('latent_labels.valid','int64','1')) x(feature, dtype, shape)),
tt AS (SELECT CASE WHEN episode_index % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, count(DISTINCT episode_index) AS total_episodes,
  count(*) AS total_frames, count(DISTINCT task_index) AS total_tasks FROM frames GROUP BY 1)
"""


@query("feature_catalog", FEATURES_SQL + """
SELECT dataset, feature, dtype, shape, total_episodes, total_frames, total_tasks, '0:' || total_episodes AS split, CAST(10 AS DOUBLE) AS fps,
  CAST(1000 AS BIGINT) AS chunks_size FROM tt, ft""")
def feature_catalog(spark, sf):
    rows = datasets.feature_catalog(datasets.descriptions(spark, slim_roots(spark, sf)))
    return rows.select("dataset", "feature", "dtype", F.array_join("shape", ",").alias("shape"), "total_episodes",
                       "total_frames", "total_tasks", F.col("splits")["train"].alias("split"), "fps", "chunks_size")


@query("scan_frames", "SELECT idx, episode_index, frame_index, valid FROM frames")
def scan_frames(spark, sf):
    rows = T.frames(spark, sf).select("idx", "episode_index", "frame_index", "valid")
    root = shared_folder(spark)
    rows.withColumn("part", F.col("idx") % 3).write.partitionBy("part").parquet(f"{root}/data/chunk-000")
    rows.where("false").write.parquet(f"{root}/data/chunk-001/deep")
    schema = datasets.declared_schema({c: ("int64", (1,), T.FPS) for c in rows.columns})
    return datasets.scan_frames(spark, root, schema)


@query("scan_episode_files", """
SELECT idx, episode_index, frame_index, CASE WHEN episode_index % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset FROM frames
WHERE episode_index IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def scan_episode_files(spark, sf):
    """Wanted episodes of stored datasets, from the files that can hold them."""
    wanted = T.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("long").alias("episode_index"))
    out = None
    for name, root in zip(PARITIES, slim_roots(spark, sf)):
        rows = frame_files.scan_episodes(spark, root, wanted).select(F.col("index").alias("idx"), "episode_index", "frame_index", F.lit(name).alias("dataset"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("coerce_feature_column", """
SELECT idx, valid, valid = 1 AS flag, task_index, CAST(p AS BIGINT) AS row, round(e[16 * p + 1], 6) AS x0 FROM lf, range(4) r(p)""")
def coerce_feature_column(spark, sf):
    raw = T.labeled_frames(spark, sf).select(
        "idx", F.array("valid").alias("valid"), "task_index", F.array("slots").alias("clip"))
    out = raw.select(
        "idx", datasets.coerce_feature(raw, "valid", "bigint", (1,)).alias("valid"), datasets.valid_flag(raw, "valid").alias("flag"),
        datasets.coerce_feature(raw, "task_index", "bigint", (1,)).alias("task_index"),
        F.posexplode(datasets.coerce_feature(raw, "clip", "double", (4, 16))).alias("row", "x"))
    return out.select("idx", "valid", "flag", "task_index", F.col("row").cast("bigint").alias("row"), r6(F.col("x")[0]).alias("x0"))


@query("write_labeled_dataset", """
SELECT idx, episode_index, frame_index, CASE WHEN valid = 1 THEN round(e[1], 6) ELSE -1.0 END AS "latent_labels.x0", valid AS "latent_labels.valid" FROM lf""")
def write_labeled_dataset(spark, sf):
    rows = T.labeled_frames(spark, sf)
    labels = fr.valid_rows(rows).select("idx", r6(F.col("continuous")[0]).alias("x0"))
    root = shared_folder(spark)
    source = rows.select("idx", "episode_index", "frame_index", "valid")
    datasets.write_labeled(source, labels, {"x0": F.lit(-1.0)}, PREFIX, root)
    return datasets.scan_frames(spark, root)


@query("write_analysis_dataset", """
SELECT idx AS "index", episode_index, task_index, frame_index, "timestamp", a0, round(e[64], 6) AS x63, ids[4] AS id3, valid AS "latent_labels.valid" FROM lf""")
def write_analysis_dataset(spark, sf):
    even, odd = (datasets.scan_frames(spark, r) for r in slim_roots(spark, sf))
    rows = even.unionByName(odd)
    return rows.select("index", "episode_index", "task_index", "frame_index", "timestamp", F.col("action")[0].alias("a0"),
                       r6(F.col(f"`{PREFIX}.continuous`")[63]).alias("x63"), F.col(f"`{PREFIX}.ids`")[3].alias("id3"), f"`{PREFIX}.valid`")


def manifests(spark, sf):
    roots = slim_roots(spark, sf)
    labeled = None
    for name, root in zip(PARITIES, roots):
        one = datasets.scan_frames(spark, root).select(F.lit(name).alias("dataset"), F.col(f"`{PREFIX}.valid`").alias("valid"))
        labeled = one if labeled is None else labeled.unionByName(one)
    catalog = datasets.feature_catalog(datasets.descriptions(spark, roots)).where(F.col("feature").startswith(PREFIX))
    return datasets.export_manifest_rows(labeled, catalog, {
        "artifact_type": F.lit("latent_export"), "export_kind": F.lit("analysis_only"), "feature_prefix": F.lit(PREFIX),
        "artifact_id": text.artifact_id(F.lit("latent_export"), F.lit("v1"), F.lit(None).cast("string"), F.col("dataset"))}), roots


MANIFEST_SQL = """
, mf AS (SELECT CASE WHEN episode_index % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, count(*) AS num_rows, CAST(sum(valid) AS BIGINT) AS num_valid_labels,
  'latent_labels.continuous,latent_labels.ids' AS feature_names, 'latent_labels.valid' AS valid_feature_name, 'latent_labels.continuous' AS stats_feature_names,
  'latent_export' AS artifact_type, 'analysis_only' AS export_kind, 'latent_labels' AS feature_prefix FROM frames GROUP BY 1)
"""


@query("export_manifest_rows", MANIFEST_SQL + "SELECT *, 'latent_export__v1__' || dataset AS artifact_id FROM mf")
def export_manifest_rows(spark, sf):
    rows, _ = manifests(spark, sf)
    return rows.withColumns({c: F.array_join(c, ",") for c in ("feature_names", "stats_feature_names")})


MANIFEST_SCHEMA = (
    "dataset string, num_rows bigint, num_valid_labels bigint, feature_names array<string>, valid_feature_name string, "
    "artifact_id string, artifact_schema_version bigint, created_at string, manifest_path string, registry_path string")


@query("register_artifact", MANIFEST_SQL + """
SELECT dataset, num_rows, num_valid_labels, 'latent_export__v1__' || dataset AS artifact_id, CAST(1 AS BIGINT) AS artifact_schema_version,
  '2024-01-02T03:04:05Z' AS created_at, '/work/runs/' || dataset || '/export_manifest.json' AS manifest_path,
  '/work/runs/analysis_registry/artifacts.jsonl' AS registry_path FROM mf""")
def register_artifact(spark, sf):
    rows, _ = manifests(spark, sf)
    path = F.concat(F.lit("/work/runs/"), F.col("dataset"), F.lit("/export_manifest.json"))
    now = text.utc_text(F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    registered = datasets.with_registration(rows, path, text.registry_location([path], "runs"), now)
    registry = shared_folder(spark)
    artifact_registry.register(registered.where("dataset = 'even'"), registry)
    artifact_registry.register(registered.where("dataset = 'odd'"), registry)
    return datasets.parse_manifests(artifact_registry.records(spark, registry), MANIFEST_SCHEMA).select(
        "dataset", "num_rows", "num_valid_labels", "artifact_id", "artifact_schema_version", "created_at", "manifest_path", "registry_path")


@query("load_parent_manifest", MANIFEST_SQL + """
SELECT dataset, num_rows, CASE dataset WHEN 'even' THEN 'export_manifest.json' ELSE 'label_manifest.json' END AS manifest_name,
  dataset = 'even' AS is_export FROM mf""")
def load_parent_manifest(spark, sf):
    rows, roots = manifests(spark, sf)
    for name, root in zip(PARITIES, roots):
        one = rows.where(F.col("dataset") == name)
        one.withColumn("artifact_id", F.lit("label")).coalesce(1).write.json(f"{root}/label_manifest.json")
        if name == "even":
            one.coalesce(1).write.json(f"{root}/export_manifest.json")
    found = datasets.parent_manifests(spark, roots, MANIFEST_SCHEMA)
    return found.select("dataset", "num_rows", F.regexp_extract("manifest_path", "([^/]+)$", 1).alias("manifest_name"),
                        (F.col("artifact_id") != "label").alias("is_export"))


@query("write_result_tables", "SELECT seq AS sequence, count(*) AS count FROM v GROUP BY seq")
def write_result_tables(spark, sf):
    path = shared_folder(spark)
    datasets.write_result_table(ds.id_sequence_counts(spark, sf).select("sequence", "count"), path)
    return spark.read.option("header", True).schema("sequence string, count bigint").csv(path)


@query("write_sample_tables")
def write_sample_tables(spark, sf):
    path = shared_folder(spark)
    stored = losses(spark, sf)
    datasets.write_result_table(stored, path, per_sample=True)
    return spark.read.option("header", True).schema(stored.schema).csv(path)


@query("write_scores_parquet", PAIRS_SQL + "SELECT idx, episode_index, latent_format, round(spcfc, 6) AS spcfc FROM sc")
def write_scores_parquet(spark, sf):
    path = shared_folder(spark)
    datasets.write_scores(cosine_scores(spark, sf), path)
    return rounded(spark.read.parquet(path), "spcfc")


@query("backfill_stats_job", ds.STATS_SQL + """
, pel AS (SELECT CASE WHEN episode_index % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, p, e[p + 1] AS x FROM v, range(64) r(p)),
w2 AS (SELECT dataset, 'latent_labels.continuous' AS feature, CAST(p AS BIGINT) AS pos, min(x) AS min, max(x) AS max, avg(x) AS mean, stddev_pop(x) AS std, CAST(count(*) AS DOUBLE) AS count,
      quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.1) AS q10, quantile_cont(x, 0.5) AS q50,
      quantile_cont(x, 0.9) AS q90, quantile_cont(x, 0.99) AS q99 FROM pel GROUP BY ALL)
SELECT dataset, feature, pos, stat, round(value, 6) AS value FROM (UNPIVOT w2 ON min, max, mean, std, count, q01, q10, q50, q90, q99 INTO NAME stat VALUE value)
UNION ALL SELECT dataset, 'action', 0, 'mean', round(avg(a0), 6) FROM frames, (VALUES ('even'), ('odd')) d(dataset) GROUP BY dataset""")
def backfill_stats_job(spark, sf):
    """Statistics of both exported datasets, merged over stale ones of an action and of the labels."""
    action = T.frames(spark, sf).agg(F.avg(F.col("action")[0]).alias("value"))
    stale = action.select(F.explode(F.array(F.lit("action"), F.lit(f"{PREFIX}.continuous"))).alias("feature"),
                          F.lit(0).alias("pos"), F.lit("mean").alias("stat"), "value")
    out = None
    for name, root in zip(PARITIES, slim_roots(spark, sf)):
        merged = labeling.backfill_stats(root, spark, PREFIX, stale)[0].withColumn("dataset", F.lit(name))
        out = merged if out is None else out.unionByName(merged)
    return rounded(out.withColumn("pos", F.col("pos").cast("bigint")), "value")


def _stored_states(spark, sf):
    """States of both exported datasets, written into their folders and read from there."""
    parts = None
    for name, root in zip(PARITIES, slim_roots(spark, sf)):
        valid = datasets.scan_frames(spark, root).where(F.col(f"`{PREFIX}.valid`") == 1)
        labels, ids = F.col(f"`{PREFIX}.continuous`"), F.col(f"`{PREFIX}.ids`")
        st.feature_state(valid, {f"{PREFIX}.continuous": labels}).write.parquet(f"{root}/meta/state/features")
        st.distinct_state(valid, ids).write.parquet(f"{root}/meta/state/sequences")
        one = [spark.read.parquet(f"{root}/meta/state/{k}").withColumn("dataset", F.lit(name)) for k in ("features", "sequences")]
        parts = one if parts is None else [a.unionByName(b) for a, b in zip(parts, one)]
    return parts


@query("merge_feature_states", """
, el AS (SELECT p, e[p + 1] AS x FROM v, range(64) r(p))
SELECT 'latent_labels.continuous' AS feature, CAST(p AS BIGINT) AS pos, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
  round(min(x), 6) AS low, round(max(x), 6) AS high, CAST(5 AS BIGINT) AS quantiles_within_bound FROM el GROUP BY p""")
def merge_feature_states(spark, sf):
    """Statistics of both datasets from their states; the ranks of the sketches' quantiles are counted in the rows."""
    states = written(spark, st.merged(_stored_states(spark, sf)[0], ["feature", "pos"]))
    probs = fixed.STAT_QUANTILES
    wide = states.select("feature", "pos", "n", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"), "low", "high", F.array(*st.quantiles(probs)).alias("q"))
    rows = fr.valid_rows(T.labeled_frames(spark, sf)).select(F.posexplode("continuous").alias("pos", "x"))
    below = rows.join(F.broadcast(wide.select("pos", "q")), "pos").groupBy("pos").agg(  # one row per position
        *[F.count_if(F.col("x") < F.col("q")[i]).alias(f"b{i}") for i in range(len(probs))], *[F.count_if(F.col("x") <= F.col("q")[i]).alias(f"t{i}") for i in range(len(probs))])
    bound = st.rank_error()
    within = [((F.col(f"b{i}") <= (p + bound) * F.col("n")) & (F.col(f"t{i}") >= (p - bound) * F.col("n"))).cast("bigint") for i, p in enumerate(probs.values())]
    out = wide.join(below, "pos").withColumn("quantiles_within_bound", sum(within[1:], within[0]))
    return rounded(out.select("feature", F.col("pos").cast("bigint").alias("pos"), "n", "mean", "std", "low", "high", "quantiles_within_bound"), "mean", "std", "low", "high")


@query("merge_distinct_states", """
, d AS (SELECT DISTINCT CASE WHEN episode_index % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, seq FROM v)
SELECT (SELECT count(*) FROM d WHERE dataset = 'even') AS even, (SELECT count(*) FROM d WHERE dataset = 'odd') AS odd, (SELECT count(DISTINCT seq) FROM d) AS both_together,
  (SELECT count(*) FROM d a JOIN d b USING (seq) WHERE a.dataset = 'even' AND b.dataset = 'odd') AS shared, (SELECT count(*) FROM v) AS row_count""")
def merge_distinct_states(spark, sf):
    """Different id sequences of both datasets, of their union and overlap, from stored sketches (exact below their size)."""
    states = written(spark, _stored_states(spark, sf)[1])
    each = states.groupBy().pivot("dataset", list(PARITIES)).agg(F.first(st.distinct_count()))
    union = st.distinct_union(states).select(st.distinct_count().alias("both_together"), F.col("rows").alias("row_count"))
    return each.crossJoin(union).crossJoin(st.overlaps(states, "dataset").select("shared")).select(  # one row each
        "even", "odd", "both_together", "shared", "row_count")


# ---- catalogs derived from the events: a dataset is one user on one day ----------------------

CATALOG_SQL = """
WITH cat AS (SELECT DISTINCT 'u' || user_id || '_d' || day(ts) AS dataset,
  CASE event_type WHEN 'click' THEN 'latent_labels.continuous_vector_latents' WHEN 'view' THEN 'latent_labels.codebook_ids'
    WHEN 'signup' THEN 'latent_labels.valid' WHEN 'purchase' THEN 'action' ELSE 'observation.latents' END AS feature,
  event_type <> 'purchase' AS is_label FROM events)
"""


def event_catalog(spark, sf):
    kind = F.col("event_type")
    feature = (F.when(kind == "click", f"{PREFIX}.continuous_vector_latents").when(kind == "view", f"{PREFIX}.codebook_ids")
               .when(kind == "signup", f"{PREFIX}.valid").when(kind == "purchase", "action").otherwise("observation.latents"))
    dataset = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("_d"), F.dayofmonth("ts").cast("string"))
    return T.table(spark, sf, "events").select(
        dataset.alias("dataset"), feature.alias("feature"), (kind != "purchase").alias("is_label")).distinct()


@query("label_name_violations", CATALOG_SQL + "SELECT dataset, feature, is_label FROM cat WHERE is_label AND feature LIKE 'observation.%'", views=False)
def label_name_violations(spark, sf):
    return ct.name_violations(event_catalog(spark, sf))


@query("resolve_features", CATALOG_SQL + """
, ch AS (SELECT dataset, CASE feature WHEN 'latent_labels.continuous_vector_latents' THEN 'continuous' WHEN 'latent_labels.codebook_ids' THEN 'ids'
   WHEN 'latent_labels.valid' THEN 'valid' ELSE 'action' END AS role, feature FROM cat WHERE feature <> 'observation.latents')
SELECT * FROM ch UNION ALL
SELECT dataset, role, 'missing' FROM (SELECT DISTINCT dataset FROM cat), (VALUES ('continuous'), ('valid'), ('action')) r(role)
WHERE (dataset, role) NOT IN (SELECT (dataset, role) FROM ch)""", views=False)
def resolve_features(spark, sf):
    return ct.resolve_features(event_catalog(spark, sf), PREFIX)


@query("feature_set_difference", CATALOG_SQL + """
, de AS (SELECT DISTINCT dataset, f AS feature FROM cat, (VALUES ('latent_labels.continuous_vector_latents'), ('latent_labels.codebook_ids'), ('latent_labels.codebook_vectors')) r(f)),
la AS (SELECT dataset, feature FROM cat WHERE feature <> 'action')
SELECT dataset, feature, 'missing' AS problem FROM (SELECT * FROM de EXCEPT SELECT * FROM la)
UNION ALL SELECT dataset, feature, 'extra' FROM (SELECT * FROM la EXCEPT SELECT * FROM de)""", views=False)
def feature_set_difference(spark, sf):
    cat = event_catalog(spark, sf)
    names = [f"{PREFIX}.{n}" for n in ("continuous_vector_latents", "codebook_ids", "codebook_vectors")]
    declared = cat.select("dataset").distinct().withColumn("feature", F.explode(F.array(*[F.lit(n) for n in names])))
    return ct.feature_differences(declared, cat.where("feature <> 'action'"))


# ---- names and paths -----------------------------------------------------------------------

TOKEN_SQL = "coalesce(nullif(regexp_replace(regexp_replace(trim({0}), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'unknown')"


@query("sanitize_token", f"""
SELECT page_id, {TOKEN_SQL.format('url')} AS url_token, {TOKEN_SQL.format("regexp_extract(url, '[?#].*$')")} AS tail_token FROM pages""", views=False)
def sanitize_token(spark, sf):
    return T.table(spark, sf, "pages").select(
        "page_id", text.sanitize_token(F.col("url")).alias("url_token"),
        text.sanitize_token(F.regexp_extract("url", "[?#].*$", 0)).alias("tail_token"))


PATH_SQL = """
WITH h AS (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host, lpad(CAST(page_id AS VARCHAR), 6, '0') AS step FROM pages),
p AS (SELECT *, CASE page_id % 5 WHEN 0 THEN '/data/runs/' || host || '/checkpoints/' || step || '/pretrained_model'
   WHEN 1 THEN '/data/runs/' || host || '/wrapper/checkpoints/' || step || '/pretrained_model' WHEN 2 THEN '/data/runs/' || host || '/checkpoints/last'
   WHEN 3 THEN '/models/' || host || '.final' END AS path FROM h)
"""


def checkpoint_paths(spark, sf):
    host = F.regexp_extract("url", "//([^/]+)", 1)
    step = F.lpad(F.col("page_id").cast("string"), 6, "0")
    kind = F.col("page_id") % 5
    run = F.concat(F.lit("/data/runs/"), host)
    path = (F.when(kind == 0, F.concat(run, F.lit("/checkpoints/"), step, F.lit("/pretrained_model")))
            .when(kind == 1, F.concat(run, F.lit("/wrapper/checkpoints/"), step, F.lit("/pretrained_model")))
            .when(kind == 2, F.concat(run, F.lit("/checkpoints/last")))
            .when(kind == 3, F.concat(F.lit("/models/"), host, F.lit(".final"))))
    return T.table(spark, sf, "pages").select("page_id", host.alias("host"), step.alias("step"), path.alias("path"))


@query("checkpoint_metadata", PATH_SQL + """
SELECT page_id, path AS source_checkpoint_path,
  CASE page_id % 5 WHEN 0 THEN host || '__' || step WHEN 1 THEN host || '__' || step WHEN 2 THEN host WHEN 3 THEN host || '.final' END AS source_checkpoint_id,
  regexp_replace(path, '/pretrained_model$', '') AS source_checkpoint_dir,
  CASE WHEN page_id % 5 <= 1 THEN step END AS source_checkpoint_step, CASE WHEN page_id % 5 <= 2 THEN host END AS source_run_name,
  CASE WHEN page_id % 5 <= 2 THEN '/data/runs/' || host END AS source_run_path FROM p""", views=False)
def checkpoint_metadata(spark, sf):
    columns = text.checkpoint_columns(F.col("path"), "wrapper")
    return checkpoint_paths(spark, sf).select("page_id", *[c.alias(n) for n, c in columns.items()])


@query("artifact_id", PATH_SQL + f"""
SELECT page_id, 'latent core'.replace(' ', '_') || '__v2' || coalesce('__' || CASE WHEN page_id % 5 <> 4 THEN {TOKEN_SQL.format('path')} END, '')
  || CASE WHEN page_id % 3 = 0 THEN '' ELSE '__' || {TOKEN_SQL.format('host')} END AS artifact_id FROM p""", views=False)
def artifact_id(spark, sf):
    label = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.col("host"))
    return checkpoint_paths(spark, sf).select("page_id", text.artifact_id(
        F.lit("latent core"), F.lit("v2"), F.col("path"), label).alias("artifact_id"))


@query("registry_location", PATH_SQL + """
SELECT page_id, CASE WHEN page_id % 5 <= 2 THEN '/data/runs/analysis_registry/artifacts.jsonl'
  WHEN page_id % 2 = 0 THEN '/x/runs/y/runs/analysis_registry/artifacts.jsonl' END AS registry_path FROM p""", views=False)
def registry_location(spark, sf):
    second = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/x/runs/y/runs/"), F.col("host")))
    return checkpoint_paths(spark, sf).select("page_id", text.registry_location([F.col("path"), second], "runs").alias("registry_path"))


@query("utc_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM events", views=False)
def utc_timestamp(spark, sf):
    return T.table(spark, sf, "events").select("event_id", text.utc_text(F.col("ts")).alias("created_at"))


@query("parse_manifests", """
SELECT event_id AS num_rows, event_type AS artifact_type, CAST(json_extract(props, '$.k') AS BIGINT) AS num_valid_labels,
  '{"artifact_type":"' || event_type || '","num_rows":' || event_id || ',"num_valid_labels":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS sorted_json
FROM events""", views=False)
def parse_manifests(spark, sf):
    lines = T.table(spark, sf, "events").select(F.to_json(F.struct(
        F.get_json_object("props", "$.k").cast("bigint").alias("num_valid_labels"), F.col("event_id").alias("num_rows"),
        F.col("event_type").alias("artifact_type"), F.lit("ignored").alias("unknown_key"))).alias("value"))
    parsed = datasets.parse_manifests(lines, "num_valid_labels bigint, num_rows bigint, artifact_type string")
    return parsed.withColumn("sorted_json", datasets.sorted_json(parsed))


HEADLINE_SQL = ds.VE_SQL + ds.CONTEXT_SUMMARY_SQL[len(ds.BUCKET_SQL):] + ds.CONSISTENCY_SUMMARY_SQL[len(ds.BUCKET_SQL):]


@query("headline_metrics", HEADLINE_SQL + """
SELECT (SELECT mean_variance_explained FROM ve WHERE feature_set = 'id_sequence' AND target = 'current_action') AS id_sequence_current_mean_variance_explained,
  (SELECT mean_variance_explained FROM ve WHERE feature_set = 'id_sequence' AND target = 'future_action_mean') AS id_sequence_future_mean_variance_explained,
  (SELECT bucket_episode_nmi FROM cs WHERE feature_set = 'id_sequence') AS id_sequence_bucket_episode_nmi,
  (SELECT action_latent_nmi FROM ps WHERE feature_set = 'id_sequence' AND action_target = 'future_action_mean') AS future_action_to_id_sequence_nmi,
  CAST(NULL AS DOUBLE) AS continuous_kmeans_bucket_episode_nmi""")
def headline_metrics(spark, sf):
    report = ds.bucket_report_fanout(spark, sf)
    long = report.select("report", "feature_set", F.coalesce("target", F.lit("")).alias("target"), F.col("metric").alias("value"))
    return headline(long, {
        "id_sequence_current_mean_variance_explained": ("action_buckets", "id_sequence", "current_action"),
        "id_sequence_future_mean_variance_explained": ("action_buckets", "id_sequence", "future_action_mean"),
        "id_sequence_bucket_episode_nmi": ("bucket_context", "id_sequence", ""),
        "future_action_to_id_sequence_nmi": ("action_to_latent", "id_sequence", "future_action_mean"),
        "continuous_kmeans_bucket_episode_nmi": ("bucket_context", "continuous_kmeans", ""),
    }, ["report", "feature_set", "target"])


# ---- label specifications and labelers -------------------------------------------------------

SPEC_SQL = """
WITH sp AS (SELECT c_nationkey AS group_id, c_custkey % 1000 AS episode,
   CASE c_mktsegment WHEN 'BUILDING' THEN 'gaussian' WHEN 'MACHINERY' THEN 'uniform' WHEN 'HOUSEHOLD' THEN 'other' ELSE 'constant' END AS mode,
   CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1.5 END AS constant_value,
   CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 END AS mean, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS std,
   CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 0.0 END AS low, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal END AS high FROM customer)
"""


def spec_table(spark, sf):
    seg = F.col("c_mktsegment")
    return T.table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("group_id"), (F.col("c_custkey") % 1000).alias("episode"),
        F.when(seg == "BUILDING", "gaussian").when(seg == "MACHINERY", "uniform").when(seg == "HOUSEHOLD", "other")
        .otherwise("constant").alias("mode"),
        F.when(seg == "AUTOMOBILE", 1.5).alias("constant_value"), F.when(seg == "BUILDING", 0.0).alias("mean"),
        F.when(seg == "BUILDING", F.col("c_acctbal")).alias("std"),
        F.when(seg.isin("MACHINERY", "AUTOMOBILE"), 0.0).alias("low"), F.when(seg == "MACHINERY", F.col("c_acctbal")).alias("high"))


@query("label_spec_check", SPEC_SQL + """
, g AS (SELECT episode, count(*) AS n, count(DISTINCT group_id) AS k, CAST(min(group_id) AS BIGINT) AS group_id FROM sp GROUP BY episode),
r AS (SELECT DISTINCT CAST(group_id AS BIGINT) AS group_id, episode, problem FROM (
  SELECT *, 'unsupported mode' AS problem FROM sp WHERE mode = 'other'
  UNION ALL SELECT *, 'constant requires constant_value' FROM sp WHERE mode = 'constant' AND constant_value IS NULL
  UNION ALL SELECT *, 'unexpected low for constant' FROM sp WHERE mode = 'constant' AND low IS NOT NULL
  UNION ALL SELECT *, 'std must be >= 0' FROM sp WHERE mode = 'gaussian' AND std < 0
  UNION ALL SELECT *, 'high must be >= low' FROM sp WHERE mode = 'uniform' AND high < low))
SELECT * FROM r UNION ALL SELECT group_id, episode, 'assigned to multiple groups' FROM g WHERE k > 1
UNION ALL SELECT group_id, episode, 'duplicate episode' FROM g WHERE n > k""", views=False)
def label_spec_check(spark, sf):
    return lab.spec_violations(spec_table(spark, sf))


HEX = "CAST('0x' || substr(md5(idx || ':' || (i // 2) || '|21'), {0}, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE)"


@query("synthetic_labels", f"""
, x AS (SELECT f.idx, i, CASE WHEN c.c_custkey IS NULL THEN 'uniform' WHEN c.c_nationkey % 2 = 0 THEN 'constant' ELSE 'gaussian' END AS mode, c.c_nationkey AS k,
   {HEX.format(1)} AS u, {HEX.format(13)} AS w, CAST(6.283185307179586 AS DOUBLE) AS turn
   FROM frames f LEFT JOIN customer c ON c.c_custkey = f.episode_index AND c.c_acctbal > 2000, range(6) t(i))
SELECT idx, CAST(i // 3 AS BIGINT) AS slot, CAST(i % 3 AS BIGINT) AS dim, round(CASE mode WHEN 'uniform' THEN -0.5 + CASE WHEN i % 2 = 0 THEN u ELSE w END WHEN 'constant' THEN k
   ELSE k + 0.25 * sqrt(-2 * ln(1 - u)) * CASE WHEN i % 2 = 0 THEN cos(turn * w) ELSE sin(turn * w) END END, 6) AS x FROM x""")
def synthetic_labels(spark, sf):
    nation = F.col("c_nationkey")
    groups = T.table(spark, sf, "customer").where("c_acctbal > 2000").select(
        F.col("c_custkey").alias("episode_index"), F.when(nation % 2 == 0, "constant").otherwise("gaussian").alias("mode"),
        nation.cast("double").alias("constant_value"), nation.cast("double").alias("mean"), F.lit(0.25).alias("std"),
        F.lit(-0.5).alias("low"), F.lit(0.5).alias("high"))
    base = {"mode": F.lit("uniform"), "constant_value": F.lit(0.0), "mean": F.lit(0.0), "std": F.lit(1.0), "low": F.lit(-0.5), "high": F.lit(0.5)}
    rows = lb.override_by_episode(T.frames(spark, sf).select("idx", "episode_index"), groups, base)
    out = lab.synthetic_labels(rows, (2, 3), 21, "double").select("idx", F.posexplode("label").alias("slot", "row"))
    out = out.select("idx", "slot", F.posexplode("row").alias("dim", "x"))
    return out.select("idx", F.col("slot").cast("bigint").alias("slot"), F.col("dim").cast("bigint").alias("dim"), r6("x").alias("x"))


def change_labeler(pdf: pd.DataFrame) -> pd.DataFrame:
    """Example of a user labeler: how much the value changes over the window, where it is whole."""
    whole = pdf[~np.stack(pdf["a0_is_pad"]).astype(bool).any(axis=1)]
    if not len(whole):
        return pd.DataFrame({"idx": whole["idx"], "change": pd.Series([], dtype=object)})
    window = np.stack([np.asarray(w, dtype=float) for w in whole["a0"]])
    return pd.DataFrame({"idx": whole["idx"], "change": list(np.stack([window[:, 1] - window[:, 0], window[:, 2] - window[:, 1]], 1))})


@query("apply_labeler", """
, w AS (SELECT idx, lag(a0) OVER o AS p, a0, lead(a0, 10) OVER o AS n FROM frames WINDOW o AS (PARTITION BY episode_index ORDER BY frame_index))
SELECT idx, CASE WHEN p IS NULL OR n IS NULL THEN -9.0 ELSE round(a0 - p, 6) END AS change0, CASE WHEN p IS NULL OR n IS NULL THEN -9.0 ELSE round(n - a0, 6) END AS change1,
  CAST(CASE WHEN p IS NULL OR n IS NULL THEN 0 ELSE 1 END AS BIGINT) AS valid FROM w""")
def apply_labeler(spark, sf):
    rows = T.frames(spark, sf).withColumn("a0", F.col("action")[0])
    plan = lab.LabelPlan({"a0": [-1, 0, 10]}, {"change": lab.Representation("array<double>", 2, -9.0)})
    full = labeling.user_labels(rows, plan, change_labeler)
    return full.select("idx", r6(F.col("change")[0]).alias("change0"), r6(F.col("change")[1]).alias("change1"), "valid")
