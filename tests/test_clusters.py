import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelens.operators import clusters as cl
from framelens.operators import models as md
from framelens.queries import learning


def blobs(spark, n, parts=3, d=5, k=6):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(k, d)) * 10
    own = rng.integers(0, k, n)
    x = centres[own] + rng.normal(size=(n, d)) * 0.3
    return x, own, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, x array<double>").repartition(parts)


@pytest.mark.parametrize("batch_rows", [400, 100_000])
def test_batches_find_separated_clusters(spark, monkeypatch, batch_rows):
    monkeypatch.setattr(cl, "BATCH_ROWS", batch_rows)
    monkeypatch.setattr(cl, "BLOCK_ROWS", 200)
    x, own, rows = blobs(spark, 3000)
    centres = cl.fit(rows, "idx", "x", 6, 3000)
    found = cl.assigned(rows, F.col("x"), centres, "bucket").orderBy("idx").toPandas()["bucket"].to_numpy()
    assert len({(a, b) for a, b in zip(found, own)}) == 6  # one bucket per blob
    assert all(np.abs(centres[b] - x[found == b].mean(0)).max() < 0.15 for b in range(6))


def test_fit_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(cl, "BLOCK_ROWS", 50)
    monkeypatch.setattr(cl, "BATCH_ROWS", 100)
    fits = [cl.fit(blobs(spark, 600, parts)[2], "idx", "x", 4, 600, cl.Fit(steps=12)) for parts in (1, 7, 30)]
    for other in fits[1:]:
        assert np.allclose(fits[0], other, atol=1e-9)


def test_fewer_different_rows_than_clusters(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(60)], "idx long, x array<double>")
    assigned, summary = md.kmeans_buckets(rows, "x", 8, None, "idx", 0, "cluster_")
    assert sorted(r["count"] for r in assigned.groupBy("bucket").count().collect()) == [20, 20, 20]
    assert summary.first().effective_clusters == 8


def test_lowest_centre_wins_a_tie(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.0])], "idx long, x array<double>")
    centres = np.array([[1.0, 0.0], [-1.0, 0.0], [1.0, 0.0]])
    assert [r.b for r in cl.assigned(rows, F.col("x"), centres, "b").orderBy("idx").collect()] == [0, 0]


def test_loss_is_close_to_full_rounds(spark):
    """Against plain rounds over all rows from the best of several random starts."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 3)) * [3, 1, 0.5]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, x array<double>")

    def loss(centres):
        return cl._squared(x, centres).min(1).sum()

    best = np.inf
    for seed in range(5):
        centres = x[np.random.default_rng(seed).choice(2000, 8, replace=False)]
        for _ in range(50):
            own = cl._squared(x, centres).argmin(1)
            centres = np.array([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(8)])
        best = min(best, loss(centres))
    assert loss(cl.fit(rows, "idx", "x", 8, 2000)) < 1.08 * best


def test_a_step_opens_only_the_files_of_its_batch(spark, monkeypatch):
    monkeypatch.setattr(cl, "BLOCK_ROWS", 50)
    x, _, rows = blobs(spark, 3000)
    table, n_batches = cl.blocks(rows, "idx", "x", 3000, 0, 100, steps=4)
    files = [{r.f for r in table.where(F.col("batch") == b).select(F.input_file_name().alias("f")).distinct().collect()} for b in range(-1, 4)]
    assert n_batches == 30 and all(files)  # batches behind the last step are not kept apart
    assert sum(map(len, files)) == len(set().union(*files)) == len(table.inputFiles())
    assert table.agg(F.sum("n")).first()[0] == 3000


def test_batches_without_rows(spark, monkeypatch):
    """One repeated key leaves all blocks but one empty."""
    monkeypatch.setattr(cl, "BLOCK_ROWS", 20)
    monkeypatch.setattr(cl, "BATCH_ROWS", 20)
    rows = spark.createDataFrame([(7, [float(i), 0.0]) for i in range(200)], "idx long, x array<double>")
    assert cl.fit(rows, "idx", "x", 2, 200).shape[1] == 2


def test_a_fit_ends_after_every_row_was_in_a_step(spark, monkeypatch):
    """Many small batches on rows without clusters, where patience ends at once."""
    monkeypatch.setattr(cl, "BLOCK_ROWS", 10)
    monkeypatch.setattr(cl, "BATCH_ROWS", 10)
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 2)))], "idx long, x array<double>")
    passed, sums = [], cl._sums
    monkeypatch.setattr(cl, "_sums", lambda table, centres: passed.append(sums(table, centres)) or passed[-1])
    assert cl.fit(rows, "idx", "x", 2, 2000, cl.Fit(patience=0)).shape == (2, 2)
    assert sum(counts.sum() for _, counts, _ in passed[1:]) >= 2000  # the first pass weighs the candidates


def test_action_buckets_fit_sixty_four_clusters_on_all_rows(spark, tmp_path):
    rng = np.random.default_rng(6)
    stamps = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(400), unit="s")
    events = pd.DataFrame({"event_id": np.arange(400), "ts": stamps.astype("datetime64[us]"), "user_id": np.arange(400) % 8,
                           "event_type": [["view", "click", "purchase"][i % 3] for i in range(400)], "value": rng.normal(size=400),
                           "props": [f'{{"k": {i}}}' for i in range(400)]})
    vectors = pd.DataFrame({"vec_id": np.arange(5), "label": np.arange(5), "embedding": list(rng.normal(size=(5, 64)).astype("float32"))})
    events.to_parquet(tmp_path / "events.parquet")
    vectors.to_parquet(tmp_path / "embeddings.parquet")
    found = learning.kmeans_action_buckets(spark, str(tmp_path)).toPandas()
    assert set(found["requested_clusters"]) == set(found["effective_clusters"]) == {64}
    assert set(found["fit_rows"]) == {320} and found.groupby("action_target")["bucket_count"].sum().tolist() == [320, 320]
    assert found.groupby("action_target")["bucket"].nunique().min() > 50
