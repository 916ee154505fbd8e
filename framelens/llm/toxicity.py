"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. Every window of
``WINDOW`` words of a text is compressed with both, behind a marker that both dictionaries hold
(blocks of a few bytes are never compressed, so a short window needs company of known cost). The
distance of a window is its length with the ordinary dictionary minus its length with the toxic
one. Thresholds on that distance are calibrated as quantiles over the windows of ordinary
documents, and a logistic fit turns the counts of windows above them into a score.

A toxic document is mostly ordinary text. What its dictionary is trained on are those of its
words that are found in more toxic than ordinary documents than chance allows (a log-likelihood
ratio of at least ``EVIDENCE``); the ordinary dictionary gets windows of ordinary documents.

The fit uses a bounded sample of labelled rows: at most ``FIT_DOCS`` documents of each label for
dictionaries, and ``CALIBRATION_DOCS`` other documents for thresholds and weights, those with the
smallest hashes. Scoring reads every document once, whole, without a shuffle.

Defined results: a null or empty text is scored as a text with one empty window; a null id is not
held out and has no label; of several labels of one id the largest counts; repeated documents are
rows like others; without labelled documents of both kinds the score is the share of toxic ones
among the labelled (0 without any), as nothing can be compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm import common

WINDOW = 2
SAMPLE_WORDS = 16
EVIDENCE = 12.0
FIT_DOCS = 20_000
CALIBRATION_DOCS = 12_000
MAX_WORDS = 50_000
MAX_SAMPLES = 40_000
TOXIC_BYTES, ORDINARY_BYTES = 16 << 10, 16 << 10
LOW, HIGH = -16, 24
TAILS = (0.01, 0.001, 0.0001)
PREDICT_AT = 0.3
MARKER = bytes((0, 1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16))
EDGES = ".,;:!?|()\"'"
BLOCK_CHARS = 1 << 20


def words(text: str | None) -> list[str]:
    """Lower-case words without punctuation at their ends."""
    found = [w.strip(EDGES) for w in (text or "").lower().split()]
    return [w for w in found if w]


def held_out(id: Column) -> Column:
    """Rows that labels must not be learned from."""
    return F.coalesce(F.crc32(id.cast("string")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Both dictionaries, thresholds and weights; ``toxic`` is empty where nothing was fitted."""

    toxic: bytes
    ordinary: bytes
    thresholds: tuple[int, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    rate: float


@cache
def _compressor(dictionary: bytes):
    """One per worker process and dictionary."""
    import zstandard as zstd

    content = zstd.ZstdCompressionDict(dictionary + MARKER, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    settings = zstd.ZstdCompressionParameters(
        window_log=16, hash_log=14, chain_log=14, search_log=4, min_match=4, target_length=24, strategy=zstd.STRATEGY_BTLAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS)
    content.precompute_compress(compression_params=settings)
    return zstd.ZstdCompressor(dict_data=content, compression_params=settings)


def _lengths(dictionary: bytes, windows: list[bytes]) -> np.ndarray:
    done = _compressor(dictionary).multi_compress_to_buffer(windows, threads=1)
    return np.fromiter(map(len, done), np.int64, len(windows))


def histograms(texts: list[str | None], toxic: bytes, ordinary: bytes) -> np.ndarray:
    """Per text, how many windows have each distance from ``LOW`` to ``HIGH`` (ends included)."""
    owners, windows = [], []
    for i, text in enumerate(texts):
        own = words(text)
        parts = [" ".join(own[at : at + WINDOW]) for at in range(0, max(1, len(own)), WINDOW)]
        windows += [MARKER + f" {p} ".encode("utf-8", "replace") for p in parts]
        owners += [i] * len(parts)
    out = np.zeros((len(texts), HIGH - LOW + 1), np.int64)
    if windows:
        distance = _lengths(ordinary, windows) - _lengths(toxic, windows)
        np.add.at(out, (np.array(owners), np.clip(distance, LOW, HIGH) - LOW), 1)
    return out


def features(counts: np.ndarray, thresholds: tuple[int, ...]) -> np.ndarray:
    """Inputs of the logistic fit, one row per text."""
    n = np.maximum(counts.sum(1), 1)
    at = np.arange(LOW, HIGH + 1)
    mean = counts @ at / n
    spread = np.sqrt(np.maximum(counts @ (at * at) / n - mean**2, 0))
    above = np.cumsum(counts[:, ::-1], 1)[:, ::-1]  # windows at this distance or more
    tops = [at[0] + (above >= k).sum(1) - 1 for k in (1, 2, 3)]
    over = [above[:, np.clip(t - LOW, 0, len(at) - 1)] for t in thresholds]
    apart = [(t - mean) / np.maximum(spread, 0.5) for t in tops]
    return np.column_stack([*tops, *apart, mean, spread, np.log1p(n), *np.log1p(over), *[x / n for x in over]])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, intercept first, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scores(counts: np.ndarray, model: Model) -> np.ndarray:
    x = (features(counts, model.thresholds) - np.array(model.means)) / np.array(model.scales)
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -30, 30)))


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, about a million characters at a time."""
    start, held, texts = 0, 0, batch.column(column)
    for i in range(batch.num_rows):
        held += len(texts[i].as_buffer()) if texts[i].is_valid else 0
        if held >= BLOCK_CHARS or i == batch.num_rows - 1:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("_order", "_tie").limit(n)


def fit_rows(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Stored sample: ``toxic``, ``part`` (words or calibration) and ``text`` of rows that may be learned from."""
    own = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
    own = own.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    own = own.withColumns({"_order": F.xxhash64(F.lit("fit"), "_id"), "part": F.when(F.xxhash64(F.lit("part"), "_id") % 5 < 3, "words").otherwise("calibration")})
    own = own.withColumn("_tie", F.col("_id"))
    chosen = [_smallest(own.where((F.col("part") == "words") & (F.col("toxic") == y)), FIT_DOCS) for y in (0, 1)]
    chosen.append(_smallest(own.where("part = 'calibration'"), CALIBRATION_DOCS))
    chosen = common.stored(chosen[0].unionByName(chosen[1]).unionByName(chosen[2]))
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("text"))
    return common.stored(rows.join(F.broadcast(chosen), "_id").select("_order", "toxic", "part", "text"))  # a bounded sample


def telling_words(rows: DataFrame) -> tuple[list[str], int, int]:
    """Words that toxic documents hold beyond chance (strongest first), and the documents of each kind."""

    def distinct(batches):
        for batch in batches:
            for block in _blocks(batch, 1):
                found = [(w, y) for y, t in zip(block.column(0).to_pylist(), block.column(1).to_pylist()) for w in set(words(t))]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())], names=["word", "toxic"])

    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return [], n0, n1
    held = rows.select("toxic", "text").mapInArrow(distinct, "word string, toxic int").groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    expected = (F.col("a") + F.col("b")) * (n1 / (n0 + n1))
    ratio = 2 * (F.col("a") * F.log(F.col("a") / expected) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (F.col("a") + F.col("b") - expected))).otherwise(0.0))
    best = held.where("a >= 2").withColumn("g", ratio).where((F.col("a") > expected) & (F.col("g") >= EVIDENCE))
    return [r.word for r in best.orderBy(F.desc("g"), "word").limit(MAX_WORDS).collect()], n0, n1


def _samples(rows: DataFrame, wanted: frozenset[str] | None = None) -> list[bytes]:
    """At most ``MAX_SAMPLES`` runs of words (only the wanted ones, if given), those with the smallest hashes."""

    def cut(batches):
        for batch in batches:
            for block in _blocks(batch, 0):
                own = [[w for w in words(t) if wanted is None or w in wanted] for t in block.column(0).to_pylist()]
                parts = [" ".join(w[i : i + SAMPLE_WORDS]) for w in own for i in range(0, len(w), SAMPLE_WORDS)]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], names=["sample"])

    found = rows.select("text").mapInArrow(cut, "sample string").withColumn("_order", F.xxhash64("sample"))
    return [f" {r.sample} ".encode("utf-8", "replace") for r in found.orderBy("_order", "sample").limit(MAX_SAMPLES).collect()]


def _trained(samples: list[bytes], size: int, k: int) -> bytes:
    """A zstandard dictionary; the plain texts where there are too few to train on."""
    import zstandard as zstd

    plain = b"".join(reversed(samples))[-size:]
    total = sum(map(len, samples))
    if total < 4 * size:
        samples = samples * (4 * size // max(total, 1) + 1)
    try:
        return zstd.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstd.ZstdError:
        return plain


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Dictionaries, thresholds and weights, from the bounded sample only."""
    rows = fit_rows(docs, labels, id, text, label)
    learn = rows.where("part = 'words'")
    telling, n0, n1 = telling_words(learn)
    toxic = _samples(learn.where("toxic = 1"), frozenset(telling)) if telling else []
    if not toxic:
        return Model(b"", b"", (), (), (), (), n1 / (n0 + n1) if n0 + n1 else 0.0)
    first, second = _trained(toxic, TOXIC_BYTES, 24), _trained(_samples(learn.where("toxic = 0")), ORDINARY_BYTES, 48)
    held = histogram_rows(rows.where("part = 'calibration'"), first, second, "toxic").orderBy("id", "counts").collect()
    if len({r.id for r in held}) < 2:
        return Model(b"", b"", (), (), (), (), n1 / (n0 + n1))
    counts, y = np.array([r.counts for r in held]), np.array([r.id for r in held], float)
    usual = counts[y == 0].sum(0)
    beyond = np.cumsum(usual[::-1])[::-1] / usual.sum()
    thresholds = tuple(int(LOW + np.argmax(np.append(beyond, 0) <= q)) for q in TAILS)
    x = features(counts, thresholds)
    means, scales = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    weights = _logistic((x - means) / scales, y)
    return Model(first, second, thresholds, tuple(means.tolist()), tuple(scales.tolist()), tuple(weights.tolist()), float(y.mean()))


def histogram_rows(rows: DataFrame, toxic: bytes, ordinary: bytes, id: str) -> DataFrame:
    """``id`` and ``counts``: windows of the text at every distance."""

    def counted(batches):
        for batch in batches:
            for block in _blocks(batch, 1):
                found = histograms(block.column(1).to_pylist(), toxic, ordinary)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(found.tolist(), pa.list_(pa.int64()))], names=["id", "counts"])

    return rows.select(F.col(id).alias("id"), "text").mapInArrow(counted, f"id {dict(rows.dtypes)[id]}, counts array<long>")


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``score``, ``n_windows`` and ``n_beyond`` (windows above the strictest threshold) of every document."""

    def scored(batches):
        for batch in batches:
            for block in _blocks(batch, 1):
                if model.toxic:
                    counts = histograms(block.column(1).to_pylist(), model.toxic, model.ordinary)
                    own, n = scores(counts, model), counts.sum(1)
                    beyond = counts[:, max(model.thresholds[-1] - LOW, 0):].sum(1)
                else:
                    own, n, beyond = np.full(block.num_rows, model.rate), np.zeros(block.num_rows, int), np.zeros(block.num_rows, int)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(own, pa.float64()), pa.array(n, pa.int64()), pa.array(beyond, pa.int64())],
                                                 names=[id, "score", "n_windows", "n_beyond"])

    return docs.select(id, text).mapInArrow(scored, f"`{id}` {dict(docs.dtypes)[id]}, score double, n_windows long, n_beyond long")
