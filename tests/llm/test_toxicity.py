import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.llm import toxicity
from framelens.llm.op13 import op13_toxicity
from tests.llm import tables

INSULTS = ["numskullery", "vilewretch", "dunderpate", "fopdoodle", "gobermouch"]
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900):
    rows, labels = [], []
    for i in range(n):
        rnd, words = random.Random(i), tables.prose(i, 40 + i % 60).split()
        bad = i % 6 == 0
        for _ in range(3 if bad else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, tables.DOCS), spark.createDataFrame(labels, LABELS)


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    docs, given = frames(spark, rows, labels)
    docs = docs.withColumns({c: F.lit(1) for c in ("toxic", "score", "part", "_order", "counts")})
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, given)).collect()}
    held = [i for i, _, toxic in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    y = np.array([labels[i][2] for i in held])
    s = np.array([got[i] for i in held])
    assert all(0 <= v <= 1 for v in got.values())
    assert (s[y == 1] >= toxicity.PREDICT_AT).mean() > 0.85 and (s[y == 0] >= toxicity.PREDICT_AT).mean() < 0.1


def test_held_out_labels_are_never_learned(spark):
    rows, labels = corpus(400)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    docs, given = frames(spark, rows, labels)
    assert toxicity.fit(docs, given) == toxicity.fit(docs.repartition(7), spark.createDataFrame(turned, LABELS))


def test_awkward_documents_and_labels(spark):
    rows, labels = corpus(300)
    model = toxicity.fit(*frames(spark, rows, labels + [(None, 1, 1), (0, 1, None), (99_999, 1, 1)]))
    odd = spark.createDataFrame(tables.awkward() + [(77, "word " * 100_000, "en", "s", 1)], tables.DOCS)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(tables.awkward()) + 1 and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.n_windows == 1 and r.doc_id in (3, 4, 5)}
    assert len(empty) == 1  # null, empty and blank texts are one empty window
    assert toxicity.score(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("toxic, score", [([], 0.0), ([0, 0, 0, 0], 0.0), ([1, 1, 1, 1], 1.0)])
def test_without_both_kinds_the_share_is_the_score(spark, toxic, score):
    rows, _ = corpus(20)
    docs, given = frames(spark, rows, [(i, 1, t) for i, t in enumerate(toxic)])
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, given)).collect()} == {score}


def test_short_windows_are_compressed_behind_the_marker():
    toxic, ordinary = b" ".join(w.encode() for w in INSULTS), b" ".join(tables.prose(1, 200).encode().split())
    bad, good = (toxicity.histograms([t], toxic, ordinary)[0] for t in ("fopdoodle", tables.prose(1, 2)))
    at = np.arange(toxicity.LOW, toxicity.HIGH + 1)
    assert (bad * at).sum() > 3 and (good * at).sum() < 0


def test_query_columns_and_held_out_rows(spark):
    got = op13_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and set(got[0].asDict()) >= {"doc_id", "held_out", "score", "predicted"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in got)
