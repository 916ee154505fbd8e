import hashlib
import zlib

import numpy as np
import pytest

from framelens.llm import merkle
from framelens.llm.op12 import FIELDS, op12_merkle_manifest
from tests.llm import tables


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]  # doc_id, source, lang, n_chars, text
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def merged(nodes):
    """Levels of a tree, from its leaves to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = nodes[at - at % 8 : at - at % 8 + 8]
        out.append((at % 8, run[: at % 8] + run[at % 8 + 1 :]))
        at //= 8
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: merged([h for _, h in sorted(((r[0] is not None, r[0] or 0), leaf(r, r[1])) for r in groups[g])]) for g in names}
    whole = merged([trees[g][-1][0] for g in names])
    out, root = [], whole[-1][0]
    for g in names:
        own = sorted(groups[g], key=lambda r: ((r[0] is not None, r[0] or 0), leaf(r, r[1])))
        for at, r in enumerate(own):
            way = [*steps(trees[g], at), *steps(whole, names.index(g))]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if tampered else r[1]
            node = leaf(r, lowered)
            for place, others in way:
                node = sha(*others[:place], node, *others[place:])
            out.append((r[0], leaf(r, r[1]), trees[g][-1][0], root, sha(*[o for _, others in way for o in others]), node, node == root))
    return out


def rows_of(n):
    langs = ["en", "en", "en", "de", None, "ßx", "a"]
    return [(i, f"Text NUMBER {i}" if i % 4 else f"text {i}", langs[i % 7] if i % 11 else f"l{i}", None if i % 5 == 0 else "s", i) for i in range(n)]


def found(spark, rows):
    docs = spark.createDataFrame(rows, tables.DOCS)
    got = merkle.manifest(docs, "doc_id", "lang", FIELDS, "text").collect()
    return [(r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got]


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_equals_plain_trees(spark, monkeypatch, height):
    """Also where a tree takes several levels of blocks, and the tree of groups too."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 8**height)
    rows = rows_of(700)
    got = found(spark, rows)
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    assert {v for *_, v in got} == {True, False}


def test_awkward_rows(spark):
    rows = tables.awkward() + [(5, "A", "", "s", 1), (5, "A", "", "s", 1), (None, "ABC", None, None, None), (-3, "Ab", "en", "é", 2)]
    assert sorted(map(repr, found(spark, rows))) == sorted(map(repr, brute(rows)))
    assert found(spark, []) == []
    one = [(3, "Only", "en", "s", 4)]
    assert found(spark, one) == brute(one) and found(spark, one)[0][4] == sha()


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_keep_subtrees_together(levels):
    places = merkle.addresses(levels)
    whole = np.concatenate(places)
    assert sorted(whole) == list(range(len(whole))) and [len(p) for p in places] == [8**d for d in range(levels)]
    top = levels // 2
    if top:
        size = sum(8**d for d in range(levels - top))
        for child in range(8**top):  # a bottom subtree fills one stretch
            own = np.concatenate([places[top + d][child * 8**d : (child + 1) * 8**d] for d in range(levels - top)])
            assert own.max() - own.min() + 1 == size == len(own)


def test_blocks_find_siblings_by_address():
    leaves = np.frombuffer(b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(600)), np.uint8).reshape(-1, 32)
    block = merkle.Block.build(leaves, 4)
    nodes = [merkle.digest(*[x.tobytes().hex() for x in leaves[i : i + 8]]) for i in range(0, 600, 8)]
    assert block.texts(3) == "".join(nodes)
    assert all(merkle.fold(leaves[i].tobytes().hex(), s) == block.texts(0) for i, s in enumerate(block.steps()))


def test_query(spark):
    got = op12_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    assert sorted((r.doc_id, r.folded_root) for r in got) == sorted((x[0], x[5]) for x in brute([tuple(d) for d in docs]))
