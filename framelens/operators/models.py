"""Models over label tensors: scaling, clusters, components and held-out probes.

Fits are distributed aggregations (moments, Gram matrices) or Spark ML estimators; only
matrices whose size is set by the declared shapes reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.functions import tensors
from framelens.operators import clusters as cl
from framelens.operators import network as net
from framelens.operators import wide as wd
from framelens.operators.ordering import sized
from framelens.operators.sampling import episode_split, fit_sample, row_split
from framelens.operators.scores import probe_scores, union_probes
from framelens.session import in_part, parts_of, written, written_in_parts

GRAM_LIMIT = 4096
BLOCK_GRAM = 1024  # sums of products up to this width are added up as matrices in Arrow batches


def moments(fit_rows: DataFrame, feature: Column) -> DataFrame:
    """One row: mean and population std per position of an array feature."""
    stats = fit_rows.select(array_to_vector(tensors.doubles(feature)).alias("v")).agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")
    )
    n = F.col("s.count")
    std = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n))
    return stats.select(F.struct(vector_to_array("s.mean").alias("mean"), std.alias("std")).alias("m"))


def standardize(rows: DataFrame, feature: str, fit_rows: DataFrame, out: str, stored: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std with the statistics of the fit rows only, which may be ``stored`` already."""
    m = (moments(fit_rows, F.col(feature)) if stored is None else stored).scalar()
    return rows.withColumn("_m", m).withColumn(
        out, tensors.standardized(F.col(feature), F.col("_m.mean"), F.col("_m.std"))
    ).drop("_m")


def _fit_rows(rows: DataFrame, n: int | None, key: str, seed: int | str) -> DataFrame:
    """A capped sample is written, since fitting reads it many times; all rows are read as they are."""
    return rows if n is None else written(rows.sparkSession, fit_sample(rows, n, key, seed))


def scaled_clusters(rows: DataFrame, feature: str, centres: DataFrame, mean: list[float], std: list[float], prefix: str) -> DataFrame:
    """Rows with ``bucket`` (number of the nearest scaled centre, the lowest on ties) and ``bucket_label``.

    ``centres`` is a stored table of ``code_id`` (0, 1, ...) and ``code``, on the scale of (x - mean) / std.
    """
    own = np.array([r.code for r in centres.orderBy("code_id").collect()])  # as many as clusters were asked for
    scaled = tensors.standardized(F.col(feature), F.array(*map(F.lit, mean)), F.array(*map(F.lit, std)))
    return cl.assigned(rows, scaled, own, "bucket").withColumn("bucket_label", F.concat(F.lit(prefix), F.col("bucket").cast("string")))


def kmeans_centres(
    rows: DataFrame, feature: str, clusters: int, fit_rows: int | None, key: str, seed: int
) -> tuple[DataFrame, list[float], list[float], int]:
    """Stored centres (``code_id``, ``code``), the mean and deviation they are scaled by, and the number of rows.

    Mini-batches move the centres; a cap on fit rows draws a sample first.
    """
    n = rows.count()
    sample = _fit_rows(rows.select(key, feature), fit_rows, key, seed)
    m = moments(sample, F.col(feature)).first()["m"]
    scaled = sample.select(key, tensors.standardized(F.col(feature), F.array(*map(F.lit, m["mean"])), F.array(*map(F.lit, m["std"]))).alias("_x"))
    found = cl.fit(scaled, key, "_x", min(clusters, n), n if fit_rows is None else min(fit_rows, n), cl.Fit(seed=seed))
    centres = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "code_id bigint, code array<double>")
    return written(rows.sparkSession, centres), m["mean"], m["std"], n


def kmeans_buckets(
    rows: DataFrame, feature: str, clusters: int, fit_rows: int | None, key: str, seed: int, prefix: str
) -> tuple[DataFrame, DataFrame]:
    """Assigned rows (``bucket``, ``bucket_label``) and one summary row with the center norms."""
    centres, mean, std, n = kmeans_centres(rows, feature, clusters, fit_rows, key, seed)
    norm = tensors.l2_norm(F.col("code"))
    fitted = n if fit_rows is None else min(fit_rows, n)
    summary = centres.agg(F.avg(norm).alias("mean"), F.stddev_pop(norm).alias("std")).select(
        F.lit(fitted).cast("bigint").alias("fit_rows"), F.lit(clusters).cast("bigint").alias("requested_clusters"),
        F.lit(min(clusters, n)).cast("bigint").alias("effective_clusters"), F.col("mean").alias("cluster_center_l2_norm_mean"), F.col("std").alias("cluster_center_l2_norm_std"))
    return scaled_clusters(rows, feature, centres, mean, std, prefix), summary


def principal_plane(
    rows: DataFrame, feature: str, usage: str | None, key: str, fit_rows: int | None, shown: int | None, seed: int
) -> DataFrame:
    """Two principal components of a sample: x, y, usage_count and its log10.

    ``usage`` names the id column whose usage colours the sample; the counts are looked up
    for the drawn rows only. Each component points to the side of its largest loading. Wide
    features get their axes by a randomized range finder, so no matrix of width by width is made.
    """
    fit_on = _fit_rows(rows.select(key, feature), fit_rows, key, f"{seed}-fit").select(array_to_vector(feature).alias("_v"))
    size = fit_on.select("_v").first()[0].size
    if size <= GRAM_LIMIT:
        model = PCA(k=2, inputCol="_v", outputCol="_pc").fit(fit_on)
        axes = model.pc.toArray()
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
        mean = np.array(fit_on.agg(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray())
    else:
        axes, _, mean = wd.principal_axes(fit_on, "_v", 2, seed)
    drawn = _fit_rows(rows.select(key, feature), shown, key, f"{seed}-shown")
    if usage is not None:
        drawn = _with_usage(rows, drawn, usage, key)
    placed = linear_predictions(drawn.withColumn("_v", array_to_vector(feature)), "_v", axes, -mean @ axes, "_pc")
    count = F.lit(1).cast("bigint") if usage is None else F.col("_usage")
    return placed.select(key, F.col("_pc")[0].alias("x"), F.col("_pc")[1].alias("y"), count.alias("usage_count"), F.log10(count).alias("log10_usage_count"))


def _with_usage(rows: DataFrame, drawn: DataFrame, ids: str, key: str) -> DataFrame:
    """``_usage`` of the drawn rows. Only their ids and keys are broadcast, if they are few."""
    n = drawn.count()
    named = written(rows.sparkSession, rows.select(key, ids).join(sized(drawn.select(key), n), key, "left_semi"))
    counts = rows.groupBy(ids).agg(F.count("*").alias("_usage"))
    used = counts.join(sized(named, n), ids).select(key, "_usage")
    return drawn.join(used, key)


# ---- probes --------------------------------------------------------------------------------


def one_hot(rows: DataFrame, fit_rows: DataFrame, ids: str, positions: int, out: str) -> DataFrame:
    """Sparse one-hot of each position, fitted on the fit rows; an unseen token gives zeros."""
    raw = [f"_id{p}" for p in range(positions)]

    def split(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(ids)[p].cast("string") for p, c in enumerate(raw)})

    index = [f"{c}_i" for c in raw]
    hot = [f"{c}_h" for c in raw]
    model = Pipeline(stages=[
        StringIndexer(inputCols=raw, outputCols=index, stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCols=index, outputCols=hot, handleInvalid="error", dropLast=True),
        VectorAssembler(inputCols=hot, outputCol=out),
    ]).fit(split(fit_rows))
    return model.transform(split(rows)).drop(*raw, *index, *hot)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix; a missing row is an error."""
    if lists.null_count:
        raise ValueError("a row has no vector")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _gram(rows: DataFrame, x: str, y: str, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of outer products, means and count of vectors ``x`` and arrays ``y`` side by side, aggregated on the executors."""
    if width > BLOCK_GRAM:
        joined = VectorAssembler(inputCols=[x, "_v"], outputCol="_xy").transform(rows.select(array_to_vector(y).alias("_v"), x)).select("_xy")
        stats = joined.agg(Summarizer.metrics("mean", "count").summary(F.col("_xy")).alias("s")).first()["s"]
        gram = RowMatrix(MLUtils.convertVectorColumnsFromML(joined, "_xy")).computeGramianMatrix().toArray()
        return gram, np.asarray(stats["mean"].toArray()), int(stats["count"])

    def summed(batches):
        total = np.zeros((width + 1, width))  # outer products, and a row of sums
        n = 0
        for batch in batches:
            if batch.num_rows:
                own = np.hstack([_matrix(batch.column(0)), _matrix(batch.column(1))])
                n, total[:width], total[width] = n + len(own), total[:width] + own.T @ own, total[width] + own.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()])], names=["n", "sum"])

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros((width + 1) * width)
        for part in group["sum"]:
            total += np.frombuffer(part.as_py(), "<f8")
        return pa.table({"n": pa.array([sum(group["n"].to_pylist())], pa.int64()), "sum": [total.tobytes()]})

    parts = rows.select(vector_to_array(x).alias("x"), F.col(y).cast("array<double>").alias("y")).mapInArrow(summed, "n long, sum binary")
    grouped = parts.groupBy((F.spark_partition_id() % wd.SUM_GROUPS).alias("g")).applyInArrow(added, "n long, sum binary")
    found = grouped.collect()  # at most SUM_GROUPS rows
    n, total = sum(r["n"] for r in found), sum(np.frombuffer(r["sum"], "<f8") for r in found).reshape(width + 1, width)
    return total[:width], total[width] / n, n


def ridge_weights(train: DataFrame, x: str, y: str, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x targets) and intercepts of a multi-output ridge regression.

    One aggregation gives the Gram matrix of features and targets together; only a matrix of
    that size is solved on the driver. Wider features are fitted by conjugate gradients, for all
    targets at once.
    """
    first = train.select(x, F.size(y).alias("a")).first()
    d, a = first[0].size, first[1]
    if d + a > GRAM_LIMIT:
        return wd.ridge(train, x, y, a, alpha)
    gram, mean, n = _gram(train, x, y, d + a)
    centred = gram - n * np.outer(mean, mean)
    weights = np.linalg.solve(centred[:d, :d] + alpha * np.eye(d), centred[:d, d:])
    return weights, mean[d:] - mean[:d] @ weights


def linear_predictions(rows: DataFrame, x: str, weights: np.ndarray, intercepts: np.ndarray, out: str) -> DataFrame:
    """Matrix product over Arrow batches; wide vectors are multiplied as they are stored, and dropped."""
    if len(weights) > GRAM_LIMIT:
        return wd.products(rows, x, weights, intercepts, out)

    @F.arrow_udf("array<double>")
    def predict(features: pa.Array) -> pa.Array:
        found = _matrix(features) @ weights + intercepts if len(features) else np.empty((0, weights.shape[1]))
        ends = np.arange(len(features) + 1, dtype=np.int32) * found.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

    return rows.withColumn(out, predict(vector_to_array(x)))


def relu_features(rows: DataFrame, x: str, size: int, width: int, seed: int, out: str) -> DataFrame:
    """The features themselves and ``width`` rectified random projections of them."""
    rng = np.random.default_rng(seed)
    projection = rng.normal(size=(size, width)) / np.sqrt(max(size, 1))
    bias = rng.normal(size=width)

    @F.pandas_udf("array<double>")
    def lift(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        base = np.stack(features.to_numpy())
        return pd.Series(list(np.hstack([base, np.maximum(base @ projection + bias, 0.0)])))

    return rows.withColumn(out, array_to_vector(lift(vector_to_array(x))))


def _probe_inputs(split: DataFrame, feature_set: str, feature: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows with vector ``_x``, fitted on the train side, and the stored moments, if it is scaled.

    The rows are not stored: every pass computes them again from the split.
    """
    train = split.where("side = 'train'")
    if feature_set == "ids_onehot":
        positions = split.select(F.size(feature)).first()[0]
        return one_hot(split, train, feature, positions, "_x"), None
    stored = written(split.sparkSession, moments(train, F.col(feature)))
    return standardize(split, feature, train, "_s", stored).withColumn("_x", array_to_vector("_s")), stored


def fit_probe(
    split: DataFrame, feature_set: str, feature: str, targets: dict[str, str], split_mode: str,
    model: str, alpha: float, width: int = 128, seed: int = 0, key: str = "idx", network: net.Settings | None = None,
) -> DataFrame:
    """Scores of one probe on the held-out rows of a split.

    ``ridge`` is linear. ``mlp`` trains a network per target by gradients. ``relu`` is a cheaper
    nonlinear probe: a hidden layer of random rectified units, of which the output layer is fitted.
    """
    if model == "mlp":
        return fit_networks(split, {feature_set: feature}, targets, split_mode, seed, key, network)
    inputs, _ = _probe_inputs(split, feature_set, feature)
    y = F.concat(*[F.col(c) for c in targets.values()])
    rows = inputs.select("side", "_x", y.alias("_y"))
    n_train = rows.where("side = 'train'").count()
    if model == "relu":
        size = rows.select("_x").first()[0].size
        rows = relu_features(rows, "_x", size, max(1, min(width, n_train // 4)), seed, "_lifted")
        rows = written(split.sparkSession, rows.select("side", F.col("_lifted").alias("_x"), "_y"))
    elif model != "ridge":
        raise ValueError(f"unsupported probe model {model!r}")
    train, test = rows.where("side = 'train'"), rows.where("side = 'test'")
    weights, intercepts = ridge_weights(train, "_x", "_y", alpha)
    return _probe_scores(linear_predictions(test, "_x", weights, intercepts, "_p"), split, targets, model, split_mode, feature_set, n_train)


def _probe_scores(test: DataFrame, split: DataFrame, targets: dict[str, str], model: str, split_mode: str, feature_set: str, n_train: int) -> DataFrame:
    """Scores of the predictions ``_p`` of ``_y``."""
    dims = split.select(F.size(next(iter(targets.values())))).first()[0]
    names = F.array(*[F.lit(t) for t in targets])
    long = test.select(F.posexplode(F.arrays_zip(F.col("_y").alias("y"), F.col("_p").alias("p"))).alias("i", "z"))
    return probe_scores(long.select(
        F.lit(model).alias("probe_model"),
        F.lit(split_mode).alias("split_mode"),
        F.lit(feature_set).alias("feature_set"),
        F.element_at(names, (F.floor(F.col("i") / dims) + 1).cast("int")).alias("target"),
        F.lit(n_train).cast("bigint").alias("n_train"),
        (F.col("i") % dims).cast("bigint").alias("action_dim"),
        F.col("z.y").alias("y"),
        F.col("z.p").alias("p"),
    ))


def fit_networks(
    split: DataFrame, features: dict[str, str], targets: dict[str, str], split_mode: str,
    seed: int = 0, key: str = "idx", network: net.Settings | None = None,
) -> DataFrame:
    """Scores of a network per feature set and target; the networks of all sets are trained in the same passes."""
    inputs, xs = split.withColumn("_y", F.concat(*[F.col(c) for c in targets.values()])), [f"_x{i}" for i in range(len(features))]
    raw, scales = {}, {}
    for x, (name, column) in zip(xs, features.items()):
        inputs, stored = _probe_inputs(inputs, name, column)
        inputs, scales[x] = inputs.withColumnRenamed("_x", x), stored
        raw[x] = F.col(x) if stored is None else array_to_vector(tensors.doubles(F.col(column)))
    train, test = inputs.where("side = 'train'"), inputs.where("side = 'test'")
    n_train = train.count()
    dims = split.select(F.size(next(iter(targets.values())))).first()[0]
    spans = [(i * dims, (i + 1) * dims) for i in range(len(targets))]
    unscaled = train.select(key, "_y", *[column.alias(x) for x, column in raw.items()])
    predict = trained_networks(unscaled, scales, "_y", key, n_train, spans, network or net.Settings(seed=seed))
    return union_probes(*[
        _probe_scores(predict(test.select(x, "_y"), x, "_p"), split, targets, "mlp", split_mode, name, n_train)
        for x, name in zip(xs, features)
    ])


def trained_networks(train: DataFrame, scales: dict[str, DataFrame | None], y: str, key: str, n: int, spans: list[tuple[int, int]], settings: net.Settings):
    """Train one network per feature vector of ``scales`` and span of targets on all rows, and return a
    function that adds the predictions from one of the vectors, scaled.

    The vectors of ``train`` are not scaled yet; ``scales`` has their moments (none: they stay as they
    are). Targets are scaled to mean 0 and deviation 1 for training.
    """
    stored = written(train.sparkSession, moments(train, F.col(y)))
    m, scale = stored.scalar(), stored.first()["m"]
    shift = np.array(scale["mean"])
    deviation = np.array([s if s > 0 else 1.0 for s in scale["std"]])
    scaled = train.withColumn("_m", m).withColumn("_t", tensors.standardized(F.col(y), F.col("_m.mean"), F.col("_m.std")))
    xs = list(scales)
    table, n_batches = net.blocks(scaled, key, xs, "_t", n, settings.seed, held_out=n >= 10 * net.HELD_OUT)
    sets = [net.Features(v.size, *_mean_and_divisor(scales[x])) for x, v in zip(xs, train.select(*xs).first())]
    nets = dict(zip(xs, net.train_sets(table, n_batches, sets, spans, settings)))
    return lambda rows, x, out: net.predictions(rows, x, nets[x], shift, deviation, out)


def _mean_and_divisor(stored: DataFrame | None) -> tuple[np.ndarray | None, np.ndarray | None]:
    """What ``standardize`` subtracts and divides by."""
    if stored is None:
        return None, None
    m = stored.first()["m"]
    std = np.array(m["std"])
    return np.array(m["mean"]), np.where(std > 0, std, 1.0)


def _with_wide(split: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """The rows of a split with large columns by key, stored. Both sides of a part are shuffled at a time."""
    n = split.count()
    sizes = wide.select(*[F.size(c) for c in wide.columns if c != key]).first()
    parts = parts_of(n, 16 + sum(max(s or 0, 0) for s in sizes or []))

    def part(p: int) -> DataFrame:
        if parts == 1:
            return wide.join(sized(split, n), key)
        return wide.where(in_part(key, p, parts)).join(split.where(in_part(key, p, parts)), key)

    return written_in_parts(split.sparkSession, part, parts)


def run_probes(
    rows: DataFrame, features: dict[str, str], targets: dict[str, str], *, n: int | None = None, test_share: float = 0.2,
    split_mode: str = "episode", models: tuple[str, ...] = ("ridge", "mlp"), alpha: float = 1.0, seed: int = 0,
    key: str = "idx", wide: DataFrame | None = None, network: net.Settings | None = None,
) -> DataFrame:
    """Split once, fit every model on every available feature set, and stack the scores.

    All rows are used unless ``n`` limits them.

    ``wide`` may hold large feature columns by key; they are read for the drawn rows only, joined in
    parts and stored once. Everything else reads that table.
    """
    columns = [*rows.columns, *(wide.columns if wide is not None else [])]
    available = {name: c for name, c in features.items() if c in columns}
    if not available:
        raise ValueError("a probe needs at least one feature set")
    if split_mode == "row":
        split = row_split(rows, n, test_share, key, seed)
    elif split_mode == "episode":
        split = episode_split(rows, n, test_share, seed)
    else:
        raise ValueError(f"unsupported split {split_mode!r}")
    own = [c for c in available.values() if c in rows.columns]
    split = written(rows.sparkSession, split.select(key, "side", *own, *targets.values()))
    if wide is not None:
        split = _with_wide(split, wide.select(key, *[c for c in available.values() if c not in own]), key)
    found = []
    for model in models:
        if model == "mlp":
            found.append(fit_networks(split, available, targets, split_mode, seed, key, network))
        else:
            found += [fit_probe(split, name, column, targets, split_mode, model, alpha, seed=seed, key=key) for name, column in available.items()]
    return union_probes(*found)
