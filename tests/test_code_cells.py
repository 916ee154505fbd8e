import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.operators import codebook as cb


def tables(spark, n, codes, size=6, spread=4.0, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, size)) * spread
    book = middle[rng.integers(0, 12, codes)] + rng.normal(size=(codes, size)) * 0.4
    x = middle[rng.integers(0, 12, n)] + rng.normal(size=(n, size)) * 0.4
    tokens = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, vector array<double>")
    return x, book, tokens, spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(book)], "code_id long, code array<double>")


def plain(x, book):
    squared = ((x[:, None, :] - book[None, :, :]) ** 2).sum(2)
    return squared.argmin(1)


@pytest.mark.parametrize("block", [5, 64])
def test_cells_equal_the_plain_search(spark, block):
    x, book, tokens, codes = tables(spark, 400, 600)
    found = cb.nearest_code(tokens, codes, ["idx"], max_numbers=200, block=block).orderBy("idx").collect()
    assert [r.code_id for r in found] == plain(x, book).tolist()
    whole = {r.idx: (r.code_id, r.sq_distance) for r in cb.nearest_code(tokens, codes, ["idx"]).collect()}
    assert {r.idx: (r.code_id, r.sq_distance) for r in found} == whole


def test_ties_go_to_the_lowest_code_of_any_cell(spark):
    grid = [[float(a), float(b)] for a in range(-6, 7) for b in range(-6, 7)]
    rng = np.random.default_rng(3)
    order = rng.permutation(len(grid))
    codes = spark.createDataFrame([(int(i), grid[j]) for i, j in enumerate(order)] + [(1000 + int(i), grid[j]) for i, j in enumerate(order)], "code_id long, code array<double>")
    half = [[a + 0.5, b + 0.5] for a in range(-5, 5) for b in range(-5, 5)] + [[a + 0.5, float(b)] for a in range(-5, 5) for b in range(-5, 5)]
    tokens = spark.createDataFrame([(i, v) for i, v in enumerate(half)], "idx long, vector array<double>")
    found = [(r.idx, r.code_id) for r in cb.nearest_code(tokens, codes, ["idx"], max_numbers=40, block=4).orderBy("idx").collect()]
    book = np.array([grid[j] for j in order])
    assert found == list(enumerate(plain(np.array(half), book).tolist()))


def test_few_pairs_are_compared(spark):
    x, book, tokens, codes = tables(spark, 500, 2000, spread=12.0)
    cells = cb.CodeCells(codes, 2000, 6, 400, 64)
    own = tokens.select("idx", F.col("vector").alias("_x"))
    sizes = {(r["_cell"], r["_part"]): r.n for r in cells.blocks.select("_cell", "_part", (F.octet_length("_ids") / 8).cast("int").alias("n")).collect()}
    assert sum(sizes.values()) == 2000 and max(sizes.values()) <= 64
    first = cells._wanted(own, ["idx"], None)
    bounded = own.join(cells._met(first, ["idx"]).withColumnRenamed("sq_distance", "_bound"), "idx")
    met = first.select("_cell", "_part").unionByName(cells._wanted(bounded, ["idx"], "_bound").select("_cell", "_part")).collect()
    pairs = sum(sizes[r["_cell"], r["_part"]] for r in met)
    assert pairs < 500 * 2000 / 5  # the plain search compares every pair
    assert [r.code_id for r in cells.nearest(own, ["idx"]).orderBy("idx").collect()] == plain(x, book).tolist()


def test_a_hot_cell_is_dealt_to_groups(spark, monkeypatch):
    monkeypatch.setattr(cb, "GROUP_TOKENS", 16)
    x, book, tokens, codes = tables(spark, 200, 50, spread=0.0)
    found = cb.nearest_code(tokens, codes, ["idx"], max_numbers=12, block=8).orderBy("idx").collect()
    assert [r.code_id for r in found] == plain(x, book).tolist()
