import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from framelens.llm import conversations
from framelens.llm.op11 import op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        fate = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2], shown[3]
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def repaired(rows):
    """One conversation, by trying all edits from the end, with whole audits and texts."""
    def order(r):
        return (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest())

    rows = sorted(rows, key=order)
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {(len(rows), state, k): (0, "", []) for state in ("", "a") for k in range(4)}
    for i in range(len(rows), -1, -1):
        for k in (3, 2, 1, 0):  # inserts made here already
            for state in ("", "s", "u", "a"):
                ways = [best[i, state, k]] if (i, state, k) in best else []
                fresh = "a" if state == "u" else "u"
                if k < 3 and (i, fresh, k + 1) in best:
                    c, audit, lines = best[i, fresh, k + 1]
                    ways.append((c + 3, "I" + audit, [("assistant:" if fresh == "a" else "user:"), *lines]))
                if i < len(rows):
                    role, text, fault = rows[i][2], rows[i][3], faults[i]
                    if (i + 1, state, 0) in best:
                        c, audit, lines = best[i + 1, state, 0]
                        ways.append((c + 4, "D" + audit, lines))
                    if fault not in ("blank", "duplicate"):
                        more = 3 * (fault == "truncated")
                        after = follow.get((state, role[:1]))
                        if after and (i + 1, after, 0) in best:
                            c, audit, lines = best[i + 1, after, 0]
                            ways.append((c + more, "K" + audit, [f"{role}:{text}", *lines]))
                        if (i + 1, fresh, 0) in best:
                            c, audit, lines = best[i + 1, fresh, 0]
                            ways.append((c + 3 + more, "R" + audit, [("assistant:" if fresh == "a" else "user:") + text, *lines]))
                if ways:
                    best[i, state, k] = min(ways, key=lambda w: w[:2])
    cost, audit, lines = best[0, "", 0]
    turns = {r[1] for r in rows} - {None}
    initials = [r[2][:1] or " " for r in rows]
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def random_rows(seed, conversations_of):
    rnd = random.Random(seed)
    rows = []
    for conv, n in conversations_of:
        for turn in range(n):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rnd.choice([f"answer {rnd.randint(0, 9)}.", f"part {rnd.randint(0, 9)}", "", " \n", None, f"what {turn}? ", "x" * 3000 + "!"])
            rows.append((conv, rnd.choice([turn, turn * 2, None, turn]), role, text))
    return rows


ROWS = random_rows(1, [(i, i % 9 + 1) for i in range(60)] + [(None, 7)])


def test_repair_equals_trying_all_edits(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(1) for c in ("ck", "seq", "part", "cost", "sig")})
    found = {r.ck: r.asDict() for r in conversations.repair(df).collect()}
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ROWS]
    for conv, rows in by_conversation(plain).items():
        row = found.pop("-" if conv is None else f"={conv}")
        row.pop("ck")
        assert row == repaired(rows), conv
    assert not found


@pytest.mark.parametrize("chunk, fan", [(4, 2), (7, 3)])
def test_long_conversations_in_chunks(spark, chunk, fan):
    rows = random_rows(2, [(1, 150), (2, 40), (3, 3), (None, 20)])
    whole = {r.ck: r for r in conversations.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    cut = {r.ck: r for r in conversations.repair(spark.createDataFrame(rows, SCHEMA), chunk=chunk, fan=fan).collect()}
    assert cut == whole
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert cut["=1"].audit == repaired(by_conversation(plain)[1])["audit"]


def test_damage(spark):
    rows = [(i, t, "assistant", f"One. Two! {i}?") for i in range(40) for t in range(3)] + [(None, None, None, None)]
    found = sorted(map(repr, (tuple(r) for r in conversations.damage(spark.createDataFrame(rows, SCHEMA)).collect())))
    assert found == sorted(map(repr, damaged(rows)))


def test_query_against_brute_force(spark, tmp_path):
    rows = random_rows(3, [(i, i % 8 + 1) for i in range(160)])
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    found = {r.conv_id: r.asDict() for r in op11_conversation_repair(spark, folder).collect()}
    after = by_conversation(damaged(rows))
    assert set(found) == {r[0] for r in rows}
    for conv, row in found.items():
        row.pop("conv_id")
        assert row == repaired(after.get(conv, [])), conv
    assert any(not after.get(conv) for conv in found)  # one that lost all rows


def test_automaton_computes_a_shared_suffix_once(spark, monkeypatch):
    signatures = ["sua", "ua", "uua", "sUa", "ua", "a", "1ua"]
    found = {r.sig: r for r in conversations.automaton(spark.createDataFrame([(x,) for x in signatures], "sig string").coalesce(1)).collect()}
    assert set(found) == set(signatures) and found["sua"].cost[3] == 0 and found["sua"].audit[3] == "KKK"
    assert found["uua"].cost[3] == 3 and found["uua"].audit[3] == "KIKK" and found["1ua"].audit[3] == "DKK"
    made, init = [], conversations.Node.__init__
    monkeypatch.setattr(conversations.Node, "__init__", lambda self, *a: (made.append(a), init(self, *a))[1])
    leaf = conversations.Node()
    shared = conversations.Node("u", conversations.Node("a", leaf))
    assert [conversations.Node(x, shared).audit(0, 3) for x in "s1"] == ["KKK", "DKK"] and len(made) == 5


def test_empty_table(spark):
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).count() == 0
