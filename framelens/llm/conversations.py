"""Repair of conversation structure by cheapest edits.

The rows of a conversation, by turn, become a signature: one symbol for a row's role and fault.
A repair keeps, reroles or deletes every row and inserts empty user or assistant rows, so that
the initials of the roles read ``(s?(ua)+)?``; cost and best audit depend on the signature alone.

Signatures of all conversations form one automaton that shares suffixes: a node is a distinct
suffix, its only edge the first symbol of it, so whatever follows an equal rest of a conversation
is computed once. Distinct signatures are sorted from their ends, so a task meets those with a
common suffix one after the other, holds the nodes of the current one on a stack, and computes
each node once: for every grammar state it may start in and every state it may end in, the
cost-to-go, the first step of the best audit, and the rank of that audit among the ends. Steps
are ``I*`` and one of ``D``, ``K``, ``R``; no step is the beginning of another, so the first step
that differs decides which audit is smaller, and ranks stand for whole audits.

Conversations of more than ``CHUNK`` rows are cut into chunks of as many neighbours at most. As a
chunk's table covers all pairs of states, tables of neighbouring chunks combine, ``FAN`` at a
time, to one per conversation, and the states chosen are handed down again; so a conversation
may hold a third of all rows. Only the SHA-256 of its repaired text needs its rows in sequence: they
are streamed in order through one task, which keeps the state of the hash and nothing else.

Defined results: a null role or text is one space, a null turn comes first, rows of equal turn
are ordered by role and a digest of their text; a role with another initial than s, u or a can
be reroled or deleted only, as can one that is empty; null conversation ids form one conversation;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm import common

CHUNK = 256
FAN = 1024
STATES = 4  # nothing yet, after the system row, after a user, after an assistant
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 40
SYMBOLS = {fault: dict(zip("suao", letters)) for fault, letters in (("", "suao"), ("truncated", "SUAO"), ("deleted", "1234"))}
ROLE_OF = {letter: role for letters in SYMBOLS.values() for role, letter in letters.items()}
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {2: "user", 3: "assistant"}  # the role that leads into a state
END_STEPS = ("", "II", "I", "")  # inserts that complete each state


def _steps(symbol: str) -> list[list[tuple[str, int, int]]]:
    """Per state, the steps over a row: their text, the state after them and their cost."""
    role, must_go, extra = ROLE_OF[symbol], symbol in "1234", TRUNCATED if symbol in "SUAO" else 0
    out = []
    for state in range(STATES):
        own, lead, cost = [], "", 0
        for _ in range(3):  # more than two inserts lead back to a state of fewer
            own.append((lead + "D", state, cost + DELETE))
            if not must_go:
                if (state, role) in NEXT:
                    own.append((lead + "K", NEXT[state, role], cost + KEEP + extra))
                own.append((lead + "R", 3 if state == 2 else 2, cost + REROLE + extra))
            lead, state, cost = lead + "I", 3 if state == 2 else 2, cost + INSERT
        out.append(sorted(own))
    return out


STEPS = {symbol: _steps(symbol) for symbol in ROLE_OF}


class Node:
    """A suffix: per start and end state its least cost, first step, state after it, and rank among the ends."""

    def __init__(self, symbol: str | None = None, rest: "Node | None" = None):
        self.rest = rest
        if rest is None:
            self.cost = [[0 if s == t else NEVER for t in range(STATES)] for s in range(STATES)]
            self.rank = [[0] * STATES for _ in range(STATES)]
            return
        self.cost, self.step, self.rank = [], [], []
        for own in STEPS[symbol]:
            cost, step = [NEVER] * STATES, [("", 0)] * STATES
            for text, after, price in own:  # ascending texts: the first of equal costs is the least
                for t, more in enumerate(rest.cost[after]):
                    if price + more < cost[t]:
                        cost[t], step[t] = price + more, (text, after)
            order = sorted(range(STATES), key=lambda t: (cost[t] >= NEVER, step[t][0], rest.rank[step[t][1]][t]))
            rank = [0] * STATES
            for place, t in enumerate(order):
                rank[t] = place
            self.cost.append(cost)
            self.step.append(step)
            self.rank.append(rank)

    def audit(self, state: int, end: int) -> str | None:
        if self.cost[state][end] >= NEVER:
            return None
        out, node = [], self
        while node.rest is not None:
            text, state = node.step[state][end]
            out.append(text)
            node = node.rest
        return "".join(out)


def automaton(signatures: DataFrame) -> DataFrame:
    """Per distinct ``sig``: ``cost`` and ``audit`` (null where unreachable) and ``rank`` for every
    start state and end state, at place 4 * start + end."""

    def rows(batches):
        path, last = [Node()], ""
        for batch in batches:
            costs, ranks, audits = [], [], []
            for backward in batch.column(0).to_pylist():
                shared = 0
                while shared < min(len(backward), len(last)) and backward[shared] == last[shared]:
                    shared += 1
                del path[shared + 1 :]
                for symbol in backward[shared:]:
                    path.append(Node(symbol, path[-1]))
                last, node = backward, path[-1]
                costs.append([c for own in node.cost for c in own])
                ranks.append([r for own in node.rank for r in own])
                audits.append([node.audit(s, t) for s in range(STATES) for t in range(STATES)])
            sigs = [x[::-1] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.string()), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32())),
                                              pa.array(audits, pa.list_(pa.string()))], names=["sig", "cost", "rank", "audit"])

    ends = signatures.select(F.reverse("sig").alias("r")).distinct()
    return ends.repartitionByRange("r").sortWithinPartitions("r").mapInArrow(rows, "sig string, cost array<long>, rank array<int>, audit array<string>")


def combine(tables: list[tuple[list[int], list[int]]], end: int | None = None):
    """Costs and ranks of a row of neighbouring chunks; with ``end``, the states to pass instead, per start."""
    ahead = [[0 if s == t else NEVER for t in range(STATES)] for s in range(STATES)]
    order = [[0] * STATES for _ in range(STATES)]
    chosen = []
    for cost, rank in reversed(tables):
        now, place, over = [], [], []
        for s in range(STATES):
            best = [min(((cost[4 * s + m] + ahead[m][t], rank[4 * s + m], m) for m in range(STATES))) for t in range(STATES)]
            now.append([min(b[0], NEVER) for b in best])
            over.append([b[2] for b in best])
            by = sorted(range(STATES), key=lambda t: (best[t][0] >= NEVER, best[t][1], order[best[t][2]][t]))
            place.append([by.index(t) for t in range(STATES)])
        ahead, order = now, place
        chosen.append(over)
    if end is None:
        return [c for own in ahead for c in own], [r for own in order for r in own]
    return [[over[s][end] for s in range(STATES)] for over in reversed(chosen)]


def conversation_key(conv: Column) -> Column:
    """A text that is never null and differs for different ids."""
    return F.when(conv.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), conv.cast("string")))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` with some dropped, emptied, cut, repeated or with the role of a user, by a hash of id and turn."""
    space = F.lit(" ")
    fate = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))) % 20
    said = F.coalesce(F.col(text), space)
    out = rows.select(F.col(conv), F.col(turn), F.when(fate == 4, F.lit("user")).otherwise(F.coalesce(F.col(role), space)).alias(role),
                      F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias(text),
                      F.when(fate == 0, F.lit(0)).when(fate == 3, F.lit(2)).otherwise(F.lit(1)).alias("_times"))
    return out.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_copy")


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Stored rows with ``seq``, ascending in the order of conversation, turn, role and text."""
    said = F.coalesce(F.col(text), F.lit(" "))
    who = F.coalesce(F.col(role), F.lit(" "))
    own = rows.select(conversation_key(F.col(conv)).alias("ck"), F.col(turn).alias("turn"), who.alias("role"), said.alias("text"))
    own = own.withColumn("same", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    by = ["ck", "turn", "role", "same"]
    return common.stored(own.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("seq", F.monotonically_increasing_id()))


def _marked(ordered: DataFrame) -> DataFrame:
    """Stored ``ck``, ``seq``, ``turn``, ``fault`` (0 none, 1 blank, 2 duplicate, 3 truncated) and ``symbol``."""
    first, n = common.stored_counted(ordered.groupBy("ck", "same").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    rows = ordered.select("ck", "same", "seq", "turn", F.substring("role", 1, 1).alias("initial"), F.right(F.btrim("text", F.lit(common.SPACES)), F.lit(1)).alias("last"))
    rows = common.join_checked(rows, first, ["ck", "same"], "left", n)
    fault = F.when(F.col("last") == "", 1).when(F.col("seq") > F.col("first"), 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0)
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("o"))
    symbol = F.when(F.col("fault").isin(1, 2), F.translate(role, "suao", "1234")).when(F.col("fault") == 3, F.upper(role)).otherwise(role)
    return common.stored(rows.withColumn("fault", fault).select("ck", "seq", "turn", "fault", symbol.alias("symbol")))


def _counts(marked: DataFrame) -> DataFrame:
    """Per conversation: rows, gaps and faults."""
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
    return marked.groupBy("ck").agg(F.count(F.lit(1)).alias("n"), gaps.alias("gaps"), *[
        F.count_if(F.col("fault") == i).alias(name) for i, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))])


def _chunks(marked: DataFrame, counts: DataFrame, chunk: int) -> DataFrame:
    """Stored runs of neighbouring rows: ``ck``, ``part`` (ascending), ``large``, ``sig`` and ``seqs``."""
    large, n = common.stored_counted(counts.where(F.col("n") > chunk).select("ck", F.lit(True).alias("large")))
    rows = common.join_checked(marked.select("ck", "seq", "symbol"), large, ["ck"], "left", n).withColumn("large", F.coalesce("large", F.lit(False)))
    rows = rows.withColumn("part", F.when(F.col("large"), F.expr(f"seq div {chunk}")).otherwise(F.lit(0)).cast("long"))
    runs = rows.groupBy("ck", "part", "large").agg(F.array_sort(F.collect_list(F.struct("seq", "symbol"))).alias("run"))
    return common.stored(runs.select("ck", "part", "large", F.array_join("run.symbol", "").alias("sig"), F.col("run.seq").alias("seqs")))


def _end(cost: Column, audit_or_rank: Column, start: int = 0) -> Column:
    """Cheapest way to end: struct of total cost, audit or rank, end state."""
    ways = [F.struct((F.get(cost, F.lit(4 * start + t)) + INSERT * len(END_STEPS[t])).alias("cost"),
                     F.get(audit_or_rank, F.lit(4 * start + t)).alias("by"), F.lit(t).alias("end")) for t in range(STATES)]
    return F.array_min(F.filter(F.array(*ways), lambda w: w["by"].isNotNull() & (w["cost"] < NEVER)))


def _fold(tables: DataFrame, fan: int) -> DataFrame:
    """Stored tables of up to ``fan`` neighbours combined."""

    def folded(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        cost, rank = combine(list(zip(table["cost"].to_pylist(), table["rank"].to_pylist())))
        return pa.table({"ck": [table["ck"][0].as_py()], "part": [table["part"][0].as_py() // fan], "cost": [cost], "rank": [rank]},
                        schema=pa.schema([("ck", pa.string()), ("part", pa.int64()), ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int32()))]))

    up = tables.withColumn("up", F.expr(f"part div {fan}"))
    return common.stored(up.groupBy("ck", "up").applyInArrow(folded, "ck string, part long, cost array<long>, rank array<int>"))


def _hand_down(tables: DataFrame, above: DataFrame, fan: int) -> DataFrame:
    """``start`` and ``end`` states of each table, from those of the table that it went into."""

    def walked(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        state, end = table["above_start"][0].as_py(), table["above_end"][0].as_py()
        starts, ends = [], []
        for over in combine(list(zip(table["cost"].to_pylist(), table["rank"].to_pylist())), end):
            starts.append(state)
            state = over[state]
            ends.append(state)
        return pa.table({"ck": table["ck"], "part": table["part"], "start": pa.array(starts, pa.int32()), "end": pa.array(ends, pa.int32())})

    keyed = above.select("ck", F.col("part").alias("up"), F.col("start").alias("above_start"), F.col("end").alias("above_end"))
    own = tables.withColumn("up", F.expr(f"part div {fan}")).join(keyed, ["ck", "up"])
    return common.stored(own.groupBy("ck", "up").applyInArrow(walked, "ck string, part long, start int, end int"))


def _chosen(chunks: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """Per conversation (``ck``, ``cost``, ``end``), and per chunk (``ck``, ``part``, ``start``, ``end``); both stored."""
    short = chunks.where("not large").withColumn("best", _end(F.col("cost"), F.col("audit")))
    ends = [short.select("ck", "best.cost", "best.end")]
    states = [short.select("ck", "part", F.lit(0).alias("start"), "best.end")]
    tables, n = common.stored_counted(chunks.where("large").select("ck", "part", "cost", "rank"))
    if n:
        levels, conversations = [tables], tables.select("ck").distinct().count()
        while n > conversations:
            levels.append(_fold(levels[-1], fan))
            n = levels[-1].count()
        top = levels[-1].withColumn("best", _end(F.col("cost"), F.col("rank")))
        ends.append(top.select("ck", "best.cost", "best.end"))
        passed = top.select("ck", "part", F.lit(0).alias("start"), "best.end")
        for level in reversed(levels[:-1]):
            passed = _hand_down(level, passed, fan)
        states.append(passed)
    return tuple(common.stored(x[0] if len(x) == 1 else x[0].unionByName(x[1])) for x in (ends, states))


def _illegal(chunks: DataFrame) -> DataFrame:
    """Neighbouring rows whose initials may not follow each other, within and between chunks."""
    roles = F.translate("sig", "SUAO1234", "suaosuao")
    inside = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length("roles") - 1, F.lit(1))), F.lit(0).cast("long"), lambda n, i: n + F.when(
        (i < F.length("roles")) & ~F.substring(F.col("roles"), i, F.lit(2)).isin("su", "ua", "au"), 1).otherwise(0))
    own = chunks.withColumn("roles", roles).select("ck", "part", "large", inside.alias("inside"), F.left("roles", F.lit(1)).alias("head"), F.right("roles", F.lit(1)).alias("foot"))
    before = F.lag("foot").over(Window.partitionBy("ck").orderBy("part"))  # one row per CHUNK rows of a large conversation
    between = own.where("large").withColumn("before", before).withColumn("inside", F.col("inside") + F.when(
        F.col("before").isNotNull() & ~F.concat("before", "head").isin("su", "ua", "au"), 1).otherwise(0)).groupBy("ck").agg(F.sum("inside").alias("illegal"))
    return own.where("not large").select("ck", F.col("inside").alias("illegal")).unionByName(between)


def _edits(chunks: DataFrame) -> DataFrame:
    """Per row ``ck``, ``seq``, ``lead`` (inserted lines before it), ``act`` (K, a new role, or null when it goes) and ``tail``."""
    each = re.compile("I*[DKR]").findall

    def inserted(state: int, n: int) -> tuple[str | None, int]:
        lines = []
        for _ in range(n):
            state = 3 if state == 2 else 2
            lines.append(f"{ROLES[state]}:")
        return ("\n".join(lines) if lines else None), state

    def rows(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                state, leads, acts, tails = row["start"], [], [], [None] * len(row["seqs"])
                for symbol, step in zip(row["sig"], each(row["audit"])):
                    lead, state = inserted(state, len(step) - 1)
                    leads.append(lead)
                    if step[-1] == "D":
                        acts.append(None)
                        continue
                    state = NEXT[state, ROLE_OF[symbol]] if step[-1] == "K" else 3 if state == 2 else 2
                    acts.append("K" if step[-1] == "K" else ROLES[state])
                if row["last"]:
                    tails[-1] = inserted(state, len(END_STEPS[row["end"]]))[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["ck"]] * len(acts), pa.string()), pa.array(row["seqs"], pa.int64()), pa.array(leads, pa.string()), pa.array(acts, pa.string()), pa.array(tails, pa.string())],
                    names=["ck", "seq", "lead", "act", "tail"])

    own = chunks.select("ck", "seqs", "sig", "start", "end", "audit", "last")
    return own.mapInArrow(rows, "ck string, seq long, lead string, act string, tail string")


def _repaired_digests(ordered: DataFrame, edits: DataFrame) -> DataFrame:
    """``ck`` and ``repaired_sha256``: rows of a conversation stream through one task in order."""

    def rows(batches):
        key, own, empty, edit = None, None, True, None

        def add(line: str | None) -> None:
            nonlocal empty
            if line is not None:
                own.update((line if empty else "\n" + line).encode("utf-8", "replace"))
                empty = False

        for batch in batches:
            keys, sums = [], []
            columns = [batch.column(i) for i in range(6)]
            for at in range(batch.num_rows):
                ck, kind, one, two, three = (columns[i][at].as_py() for i in (0, 2, 3, 4, 5))
                if ck != key:
                    if own is not None:
                        keys.append(key)
                        sums.append(own.hexdigest())
                    key, own, empty = ck, hashlib.sha256(), True
                if not kind:
                    edit = (one, two, three)
                    continue
                lead, act, tail = edit
                add(lead)
                if act is not None:
                    add(f"{one if act == 'K' else act}:{two}")
                add(tail)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums)], names=["ck", "repaired_sha256"])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([own.hexdigest()])], names=["ck", "repaired_sha256"])

    acts = edits.select("ck", "seq", F.lit(0).alias("kind"), F.col("lead").alias("a"), F.col("act").alias("b"), F.col("tail").alias("c"))
    texts = ordered.select("ck", "seq", F.lit(1).alias("kind"), F.col("role").alias("a"), F.col("text").alias("b"), F.lit(None).cast("string").alias("c"))
    both = acts.unionByName(texts).repartition("ck").sortWithinPartitions("ck", "seq", "kind")
    return both.mapInArrow(rows, "ck string, repaired_sha256 string")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Per conversation key ``ck`` with rows: gaps, faults, cost, audit and digest of the repaired text."""
    ordered = _ordered(rows, conv, turn, role, text)
    marked = _marked(ordered)
    counts = common.stored(_counts(marked))
    chunks = _chunks(marked, counts, chunk)
    table, n = common.stored_counted(automaton(chunks.select("sig")))
    tabled = common.stored(common.join_checked(chunks, table, ["sig"], "inner", n * 8))  # a row of the automaton is some kilobytes at most
    ends, states = _chosen(tabled, fan)
    last = chunks.groupBy("ck").agg(F.max("part").alias("_last"))
    walked = tabled.join(states, ["ck", "part"]).join(last, "ck").withColumn("last", F.col("part") == F.col("_last"))
    walked = common.stored(walked.select("ck", "part", "sig", "seqs", "start", "end", "last", F.get("audit", 4 * F.col("start") + F.col("end")).alias("audit")))
    audits = walked.groupBy("ck").agg(F.array_join(F.array_sort(F.collect_list(F.struct("part", "audit"))).getField("audit"), "").alias("steps"))
    tail = F.get(F.array(*[F.lit(x) for x in END_STEPS]), F.col("end"))
    digests = _repaired_digests(ordered, _edits(walked))
    out = counts.join(ends, "ck").join(audits, "ck").join(_illegal(chunks), "ck").join(digests, "ck")
    return out.select("ck", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.concat("steps", tail).alias("audit"), "repaired_sha256")
