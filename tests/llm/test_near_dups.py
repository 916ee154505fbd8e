import numpy as np
import pyarrow as pa
import pytest

from framelens.llm import near_dups
from framelens.llm.graph import components
from tests.llm import brute, tables


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.id, r.n, r.component) for r in near_dups.near_duplicates(df).collect()), key=str)


def test_equals_all_pairs(spark):
    rows = [(r[0], r[1]) for r in tables.awkward() if r[0] is not None]
    rows = list(dict(rows).items())
    for k in range(30):  # a chain of near copies: each differs from the one before by a few words
        words = tables.prose(7, 150).split()
        for i in range(k):
            words[i * 5] = f"w{i}"
        rows.append((100 + k, " ".join(words)))
    want = brute.near_duplicates(rows)
    assert found(spark, rows) == sorted(((i, n, c) for i, (n, c) in want.items()), key=str)


@pytest.mark.parametrize(("copies", "centres"), [(300, 1), (2000, 8)])
def test_hub_of_copies_with_own_edits(spark, monkeypatch, copies, centres):
    """Each copy is near the original only, so every link goes through it, whatever centres are drawn."""
    monkeypatch.setattr(near_dups, "CENTRES", centres)
    base = tables.prose(11, 150).split()
    rnd = np.random.default_rng(5)
    rows = [(5000, " ".join(base))]
    for i in range(copies):
        words = list(base)
        for block in rnd.choice(14, 4, replace=False):
            words[5 + block * 10] = f"own{i}x{block}"
        rows.append((i, " ".join(words)))
    sets = {i: brute.shingle_set(t) for i, t in rows}
    alike = lambda a, b: len(a & b) / len(a | b)
    assert all(alike(sets[i], sets[5000]) >= 0.75 for i in range(copies)) and alike(sets[0], sets[1]) < 0.75
    got = found(spark, rows)
    assert len(got) == copies + 1 and {c for _, _, c in got} == {0}


def test_close_pairs_lose_none():
    """Whatever the sizes of sets and bitmaps, no pair of different components at the threshold is ruled out."""
    rnd = np.random.default_rng(6)
    sets = []
    for size in (1, 3, 15, 17, 60, 64, 70, 500):
        base = rnd.integers(0, 2**63, 2 * size, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[: size - k * size // 20], base[size : size + k * size // 20]])) for k in range(6)]
    piece = [k % 2 for k in range(len(sets))]
    for i, j in ((0, 0), (0, 1)):
        rows = [k for k in range(len(sets)) if piece[k] in (i, j)]
        got = near_dups._close_pairs(pa.table({
            "i": pa.array([i] * len(rows), pa.int32()), "j": pa.array([j] * len(rows), pa.int32()), "node": pa.array([b"%03d" % k for k in rows]),
            "n": pa.array([len(sets[k]) for k in rows], pa.int64()), "root": pa.array([b"%d" % (k % 5) for k in rows]),
            "piece": pa.array([piece[k] for k in rows], pa.int32()), "bits": pa.array([near_dups.bitmap(sets[k]).tobytes() for k in rows])}))
        got = set(zip(got["a"].to_pylist(), got["b"].to_pylist()))
        want = {(b"%03d" % a, b"%03d" % b) for a in rows for b in rows if a < b and a % 5 != b % 5 and (i == j or piece[a] != piece[b])
                and 4 * len(set(sets[a]) & set(sets[b])) >= 3 * len(set(sets[a]) | set(sets[b]))}
        assert want and want <= got and all(x < y for x, y in got)


def test_awkward_rows(spark):
    got = found(spark, [(r[0], r[1]) for r in tables.awkward()])
    assert len(got) == len(tables.awkward())
    assert (None, 116, 0) in got and (None, 0, None) in got  # a null id joins its group; a null text stands alone
    assert got.count((2, 116, 0)) == 2 and (12, 116, 0) in got  # repeated rows; A-Z in lower case
    assert (6, 1, 6) in got and (7, 1, 6) in got and (4, 0, 4) in got
    assert found(spark, []) == []


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame(tables.awkward(), tables.DOCS)
    kept = near_dups.kept_documents(df)
    assert kept.columns == df.columns
    texts = [r.text for r in kept.collect()]
    assert len([t for t in texts if t and t.lower() == tables.prose(1, 120).lower()]) == 1
    assert "" in texts and None in texts


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(3)
    for size, shared in ((300, 240), (40, 30), (3, 2)):
        hits = []
        for _ in range(60):
            x = rnd.integers(0, 2**63, 2 * size - shared, dtype=np.uint64)
            a, b = near_dups.signatures([x[:size], x[size - shared :]])
            hits.append((a == b).mean())
        assert abs(np.mean(hits) - shared / (2 * size - shared)) < 0.05


def test_signature_equals_plain_steps():
    """Per set: every element offers step + rank along its own shuffle; the least stays."""
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 17, 400)]
    got, slots = near_dups.signatures(sets), near_dups.SLOTS
    for s, have in zip(sets, got):
        want = [2**64] * slots
        for seed in s:
            order = list(range(slots))
            for step in range(slots):
                draw = int(near_dups.mix(np.array([seed]) + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2**64))[0])
                pick = step + (draw & 0xFFFFFFFF) % (slots - step)
                order[step], order[pick] = order[pick], order[step]
                want[order[step]] = min(want[order[step]], step << 32 | draw >> 32)
        assert have.tolist() == want


def test_components_of_paths_and_stars(spark):
    name = lambda i: f"{i:04d}".encode()
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(300, 301)]
    df = spark.createDataFrame([(bytearray(name(b)), bytearray(name(a))) for a, b in links], "a binary, b binary").repartition(7)
    roots = {bytes(r.node): bytes(r.root) for r in components(df).collect()}
    assert all(roots[name(i)] == name(0) for i in range(1, 61))
    assert all(roots[name(i)] == name(100) for i in range(101, 180)) and roots[name(301)] == name(300)
