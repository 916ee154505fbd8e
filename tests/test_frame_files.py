import json

import pytest
from pyspark.sql import functions as F

from framelens.plans import labeling
from framelens.sources import datasets, frame_files


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    rows = spark.range(4000).select(
        F.col("id").alias("idx"), (F.col("id") / 50).cast("long").alias("episode_index"), F.lit(0).cast("long").alias("task_index"), (F.col("id") % 50).alias("frame_index"),
        (F.col("id") / 10).alias("timestamp"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("action"), (F.col("id") % 50 < 40).cast("long").alias("valid"),
        F.array(F.col("id").cast("double"), F.lit(2.0), F.lit(3.0)).alias("code"))
    path = str(tmp_path_factory.mktemp("files") / "slim")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    labeling.slim_export(rows, {"code": ("float64", (3,))}, path, "slim", "latent_labels", 10.0)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path


def test_only_files_with_the_episodes_are_read(spark, root):
    index = frame_files.index_files(spark, root).collect()
    assert len(index) >= 8 and sum(r.rows for r in index) == 4000 and all(r.low <= r.high for r in index)
    wanted = spark.createDataFrame([(3,), (77,), (500,), (None,)], "episode_index long")
    paths = frame_files.files_with(spark, root, wanted)
    assert len(paths) == len({r.path for r in index if r.low <= 3 <= r.high or r.low <= 77 <= r.high}) < len(index) / 2
    found = frame_files.scan_episodes(spark, root, wanted)
    assert {p.split("/")[-1] for p in found.inputFiles()} == {p.split("/")[-1] for p in paths}
    plain = datasets.scan_frames(spark, root).where("episode_index in (3, 77)")
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty() and found.count() == 100


def test_no_list_and_no_match(spark, root):
    assert frame_files.scan_episodes(spark, root, None).count() == 4000
    none = frame_files.scan_episodes(spark, root, spark.createDataFrame([(999,)], "episode_index long"))
    assert none.count() == 0 and none.columns == datasets.scan_frames(spark, root).columns


def test_a_stale_index_is_made_again(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(10).select(F.lit(1).cast("long").alias("episode_index")).write.parquet(f"{path}/data/a")
    assert frame_files.file_index(spark, path).agg(F.sum("rows")).first()[0] == 10
    spark.range(5).select(F.lit(2).cast("long").alias("episode_index")).write.parquet(f"{path}/data/b")
    wanted = spark.createDataFrame([(2,)], "episode_index long")
    assert frame_files.scan_episodes(spark, path, wanted).count() == 5


def test_description_is_one_file_for_any_reader(root):
    described = json.load(open(f"{root}/meta/info.json"))
    assert described["total_frames"] == 4000 and described["total_episodes"] == 80 and described["splits"] == {"train": "0:80"}
    assert described["features"]["latent_labels.code"] == {"dtype": "float64", "shape": [3], "names": None, "fps": 10.0}


def test_source_equals_the_scan(spark, root):
    frame_files.register(spark)
    found = spark.read.format("frames").load(root)
    plain = datasets.scan_frames(spark, root).select(*[f"`{c}`" for c in found.columns])
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    assert found.schema["latent_labels.code"].metadata == {"shape": [3], "fps": 10.0}
    assert found.rdd.getNumPartitions() == len(frame_files.index_files(spark, root).collect())


def test_source_skips_files_by_pushed_filters(spark, root):
    frame_files.register(spark)
    source = spark.read.format("frames").option("columns", "index, episode_index, latent_labels.valid").load(root)
    found = source.where("episode_index = 3 and index > 160 and `latent_labels.valid` in (1)")
    assert sorted(r["index"] for r in found.collect()) == list(range(161, 190))
    assert found.rdd.getNumPartitions() <= 2
    assert sorted(r["index"] for r in source.where("episode_index >= 79 and index % 2 = 0").collect()) == list(range(3950, 4000, 2))
    assert source.where("episode_index = 4000").count() == 0
    with pytest.raises(Exception, match="declares no feature"):
        spark.read.format("frames").option("columns", "nothing").load(root).count()
