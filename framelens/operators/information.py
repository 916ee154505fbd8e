"""Entropy, mutual information and quantile bins from counted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.operators.ordering import attach
from framelens.operators.quantiles import exact_quantiles
from framelens.session import written


def clog(count: Column) -> Column:
    """c * ln(c), 0 for c = 0."""
    return F.when(count > 0, count * F.log(count.cast("double"))).otherwise(F.lit(0.0))


def entropy_from(total: Column, clogs: Column) -> Column:
    """Entropy from n and the sum of c*ln(c); 0 for an empty or single class."""
    return F.when(total > 0, F.greatest(F.log(total.cast("double")) - clogs / total, F.lit(0.0))).otherwise(F.lit(0.0))


def entropy(counts: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """Natural-log entropy of a counted table, per key."""
    sums = counts.groupBy(*keys).agg(F.sum(count).alias("_n"), F.sum(clog(F.col(count))).alias("_c"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    return sums.select(*keys, entropy_from(n, F.coalesce(F.col("_c"), F.lit(0.0))).alias("entropy"))


def mutual_information(joint: DataFrame, keys: list[str], x: str, y: str, count: str = "count") -> DataFrame:
    """MI and NMI (natural log, arithmetic mean of the entropies) of a joint count table, per key.

    MI = H(x) + H(y) - H(x, y); all three come from aggregations of the counted table.
    """
    def part(columns: list[str], name: str) -> DataFrame:
        marginal = joint.groupBy(*keys, *columns).agg(F.sum(count).alias("_n"))
        return marginal.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.sum(clog(F.col("_n"))).alias("_c")).select(
            *keys, entropy_from(F.col("_total"), F.col("_c")).alias(name)
        )

    joined = part([x, y], "_hxy")
    for other in (part([x], "h_x"), part([y], "h_y")):
        joined = joined.join(other, keys) if keys else attach(joined, other, keys)
    mi = F.greatest(F.col("h_x") + F.col("h_y") - F.col("_hxy"), F.lit(0.0))
    mean = (F.col("h_x") + F.col("h_y")) / 2
    nmi = F.when((F.col("h_x") == 0) & (F.col("h_y") == 0), F.lit(1.0)).otherwise(F.col("mi") / mean)
    return joined.withColumn("mi", mi).withColumn("nmi", nmi).select(*keys, "mi", "nmi", "h_x", "h_y")


def target_elements(rows: DataFrame, targets: dict[str, str], *carry: str) -> DataFrame:
    """Long targets: (carry..., target, dim, y)."""
    packed = F.array(*[F.struct(F.lit(name).alias("target"), F.col(c).alias("x")) for name, c in targets.items()])
    return rows.select(*carry, F.explode(packed).alias("t")).select(
        *carry, "t.target", F.posexplode("t.x").alias("dim", "y")
    )


def bin_edges(elements: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Distinct quantiles at i / bins per key, ascending, with the number of bins."""
    probs = {f"_q{i}": i / bins for i in range(bins + 1)}
    quantiles = exact_quantiles(elements, keys, F.col(value), probs)
    edges = F.array_sort(F.array_distinct(F.array(*probs)))
    return quantiles.select(*keys, edges.alias("edges")).withColumn(
        "n_bins", F.greatest(F.size("edges") - 1, F.lit(1)).cast("bigint")
    )


def quantile_bins(elements: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """``bin``: how many inner edges are at or below the value; 0 when there is no inner edge.

    ``keys`` name targets and dimensions, so there are few rows of edges.
    """
    edges = bin_edges(elements, keys, value, bins)
    inner = F.slice(F.col("edges"), F.lit(2), F.size("edges") - 2)
    below = F.size(F.filter(inner, lambda e: e <= F.col(value)))
    bin_id = F.when(F.size("edges") <= 2, F.lit(0)).otherwise(below).cast("bigint")
    return attach(elements, edges, keys).withColumn("bin", bin_id).drop("edges", "n_bins")


def action_information(rows: DataFrame, targets: dict[str, str], bins: int, ids: str = "ids") -> DataFrame:
    """MI and NMI between id features (whole sequence, each position) and binned targets.

    Rows are counted once per (sequence, target, dim, bin); the tables of the positions are
    re-aggregations of that counted table.
    """
    elements = target_elements(rows, targets, ids)
    binned = quantile_bins(elements, ["target", "dim"], "y", bins)
    joint = binned.groupBy(ids, "target", "dim", "bin").agg(F.count("*").alias("count"))
    joint = written(rows.sparkSession, joint)
    features = F.concat(
        F.array(F.struct(F.lit("id_sequence").alias("feature"), F.array_join(ids, " ").alias("x"))),
        F.transform(
            F.col(ids),
            lambda t, i: F.struct(
                F.concat(F.lit("id_pos"), i.cast("string")).alias("feature"), t.cast("string").alias("x")
            ),
        ),
    )
    long = joint.select("target", "dim", "bin", "count", F.explode(features).alias("f")).select(
        "target", "dim", "bin", "count", "f.feature", "f.x"
    )
    return mutual_information(long, ["feature", "target", "dim"], "x", "bin").drop("h_x", "h_y")
