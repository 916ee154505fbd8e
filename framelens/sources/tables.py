"""The given tables as canonical views: frames of episodes and labels of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.functions import tensors
from framelens.operators.frames import future_action_mean, progress_context
from framelens.operators.buckets import assign_sequence_buckets
from framelens.operators.ordering import positions
from framelens.sources.prepared import prepared

TAIL = 10
FPS = 10.0
SLOTS, SLOT_SIZE = 4, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minute_of(ts: str) -> Column:
    """Minutes since the epoch of a timestamp without zone; never decreases with it."""
    return (F.unix_date(F.to_date(ts)) * 1440 + F.hour(ts) * 60 + F.minute(ts)).cast("bigint")


def order_frames(spark: SparkSession, sf_dir: str, tail: int = TAIL) -> DataFrame:
    """One row per event; an episode is a user, its frames are ordered by (ts, event_id).

    The last ``tail`` frames of an episode are invalid. Positions are found per (user,
    minute), so one very active user is spread over many tasks.
    """
    vectors = table(spark, sf_dir, "embeddings").agg(F.count("*")).scalar()
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"),
        F.col("user_id").alias("episode_index"),
        "ts",
        F.length("event_type").cast("bigint").alias("task_index"),
        F.array(
            F.col("value"),
            F.get_json_object("props", "$.k").cast("double"),
            F.length("event_type").cast("double"),
        ).alias("action"),
        (F.col("event_id") % vectors).alias("vec_id"),
    )
    placed = positions(events, ["episode_index"], minute_of("ts"), ["ts", "idx"], "frame_index", "episode_len")
    return placed.select(
        "idx",
        "episode_index",
        "task_index",
        "frame_index",
        "episode_len",
        (F.col("frame_index") / F.lit(FPS)).alias("timestamp"),
        "action",
        "vec_id",
        F.when(F.col("frame_index") < F.col("episode_len") - tail, 1).otherwise(0).cast("bigint").alias("valid"),
    )


def _token(e: Column, slot: int) -> Column:
    first = F.when(e[SLOT_SIZE * slot] > 0, 1).otherwise(0)
    second = F.when(e[SLOT_SIZE * slot + 1] > 0, 1).otherwise(0)
    return (2 * first + second).cast("bigint")


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: flat and slotted continuous label, token ids, and the vectors of the tokens."""
    e = F.col("embedding")
    ids = F.array(*[_token(e, s) for s in range(SLOTS)])
    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", "label", tensors.doubles(e).alias("continuous"), ids.alias("ids"))
        .withColumn("slots", tensors.reshape(F.col("continuous"), (SLOTS, SLOT_SIZE)))
        .withColumn(
            "codebook_vectors",
            F.flatten(
                F.transform(
                    "ids",
                    lambda t: F.array((F.floor(t / 2) * 2 - 1).cast("double"), (t % 2 * 2 - 1).cast("double")),
                )
            ),
        )
    )


FRAME_COLUMNS = (
    "idx", "episode_index", "task_index", "frame_index", "episode_len", "timestamp", "action", "vec_id", "valid"
)


def build_labeled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the labels of their vector (the join picks broadcast by size)."""
    labels = latents(spark, sf_dir).drop("slots")
    return order_frames(spark, sf_dir).join(labels, "vec_id")


def _inputs(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/events.parquet", f"{sf_dir}/embeddings.parquet"]


def labeled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored labeled dataset: frames, their labels, and the slotted form of the labels."""
    stored = prepared(spark, "labeled_frames", _inputs(sf_dir), lambda: build_labeled_frames(spark, sf_dir))
    return stored.withColumn("slots", tensors.reshape(F.col("continuous"), (SLOTS, SLOT_SIZE)))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame columns of the stored dataset; label columns are pruned at the scan."""
    return labeled_frames(spark, sf_dir).select(*FRAME_COLUMNS)


def build_valid_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per valid frame with everything the diagnostics need."""
    rows = future_action_mean(labeled_frames(spark, sf_dir).select(*FRAME_COLUMNS, "ids"), TAIL, 3)
    bucketed = assign_sequence_buckets(rows)
    progress = progress_context(frames(spark, sf_dir)).select("idx", "progress", "valid_len")
    return bucketed.join(progress, "idx").select(
        "idx", "episode_index", "frame_index", "progress", "valid_len", "ids", "bucket", "bucket_label",
        "action", "future_mean",
    )


def valid_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, "valid_frames", _inputs(sf_dir), lambda: build_valid_frames(spark, sf_dir))


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One code per embedding label: the mean vector."""
    return (
        table(spark, sf_dir, "embeddings")
        .select("label", F.posexplode("embedding").alias("pos", "v"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("v").cast("double")).alias("v"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("pairs"))
        .select(F.col("label").cast("bigint").alias("code_id"), F.col("pairs.v").alias("code"))
    )
