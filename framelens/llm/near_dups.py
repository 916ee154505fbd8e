"""Near-duplicate documents by SuperMinHash.

A document is the set of its five-word shingles, hashed to 64 bits. SuperMinHash gives every
shingle a random permutation of the signature's slots: in step j it offers rank ``j + r`` to its
j-th slot, and steps end for a document once no slot can still fall. Equal sets are one node from
the start. Nodes that agree in the four slots of a band share a bucket. Each node is first
compared, on full sets, with the smallest node that it shares a bucket with. Components are found,
and buckets that still hold several of them compare their nodes with other centres, drawn anew in
each round, while that pays. Then the buckets that are still open are finished: all their pairs of
different components are compared, in pieces of bounded size. Parity bitmaps of the sets rule out
most of these pairs: two sets differ in at least as many shingles as their bitmaps in bits.

Defined results: null, empty and blank texts have no shingles and no links; texts with fewer than
five words are one shingle; null ids come last (a component of null ids has a null id); repeated
rows are copies like any others; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm import common
from framelens.llm.graph import components

SHINGLE = 5
SLOTS = 128
ROWS = 4
PERCENT = 75
CENTRES = 1  # of an open bucket, in each further round; what rounds leave is compared afterwards
PAYS = 20  # rounds go on while one in so many compared pairs is a link
SMALL = 16  # members of an open bucket that is finished by a plain join
PIECE = 2048  # members of a piece of a larger one
BLOCK = 400_000  # shingles handled at once

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """Hash of each word, remembered; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.empty(0, _U)
    w = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, _U(size))
    for k in range(size):
        out = mix(out + w[k : len(w) - size + 1 + k])
    return np.unique(out)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set: step in the high 32 bits, random rank in the low 32."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    doc = np.repeat(np.arange(len(sets)), sizes)
    seed = np.concatenate(sets) if sets else np.empty(0, _U)
    best = np.full((len(sets), slots), np.iinfo(np.uint64).max, _U)
    flat = best.reshape(-1)
    order = None
    for step in range(slots):
        draw = mix(seed + _U((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = step + ((draw & _U(0xFFFFFFFF)) % _U(slots - step)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            rows = np.arange(len(doc))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, step]
        np.minimum.at(flat, doc * slots + slot, (_U(step) << _U(32)) | (draw >> _U(32)))
        done = best.max(axis=1) < (_U(step + 1) << _U(32))
        live = ~done[doc]
        if not live.any():
            break
        if order is None:
            doc, seed, first = doc[live], seed[live], slot[live]
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(doc), 1))
            order[np.arange(len(doc)), first] = 0
        elif live.sum() * 2 < len(live):
            doc, seed, order = doc[live], seed[live], order[live]
    return best


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` slots; keys of different bands never meet by design."""
    n, slots = signature.shape
    bands = signature.reshape(n, slots // rows, rows)
    keys = np.tile(np.arange(slots // rows, dtype=_U) * _U(0x9E3779B97F4A7C15), (n, 1))
    for k in range(rows):
        keys = mix(keys + bands[:, :, k])
    return keys.view(np.int64)


def _signature_rows(batches):
    hashes = WordHashes()

    def flush(ids, tags, sets):
        filled = [i for i, s in enumerate(sets) if len(s)]
        keys = band_keys(signatures([sets[i] for i in filled])) if filled else np.empty((0, 1), np.int64)
        nodes, bands = [None] * len(sets), [None] * len(sets)
        for row, i in enumerate(filled):
            nodes[i], bands[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), keys[row]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
             pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "th", "n", "node", "bands"])

    for batch in batches:
        ids, tags, sets, held = [], [], [], 0
        for id, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            s = shingles(text.as_buffer().to_pybytes() if text.is_valid else b"", hashes)
            ids.append(id)
            tags.append(tag)
            sets.append(s)
            held += len(s)
            if held >= BLOCK:
                yield flush(ids, tags, sets)
                ids, tags, sets, held = [], [], [], 0
        if ids:
            yield flush(ids, tags, sets)


def _set_rows(batches):
    hashes = WordHashes()
    for batch in batches:
        nodes, sets, held = [], [], 0
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = shingles(text.as_buffer().to_pybytes() if text.is_valid else b"", hashes).tobytes()
            nodes.append(node)
            sets.append(data)
            held += len(data)
            if held >= 8 * BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["node", "items"])
                nodes, sets, held = [], [], 0
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "items"])


def _confirmed(batches):
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        a, b, left, right = (batch.column(i) for i in range(4))
        keep = []
        for i in range(batch.num_rows):
            x, y = np.frombuffer(left[i].as_buffer(), _U), np.frombuffer(right[i].as_buffer(), _U)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common_items = int((both[1:] == both[:-1]).sum())
            if 100 * common_items >= PERCENT * (len(both) - common_items):
                keep.append(i)
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([a.take(take), b.take(take)], names=["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) of nodes whose sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("a_items"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("b_items"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "a_items", "b_items").mapInArrow(
        _confirmed, "a binary, b binary")


def bitmap(items: np.ndarray) -> np.ndarray:
    """Parity of the set's hashes per bit, in at least four bits a hash, up to 32768."""
    size = min(max(64, 1 << (4 * len(items) - 1).bit_length()), 1 << 15)
    odd = np.bincount((items & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(_U)


def _bitmap_rows(batches):
    for batch in batches:
        bits = [bitmap(np.frombuffer(x.as_buffer(), _U)).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["node", "bits"])


def _close_pairs(table: pa.Table) -> pa.Table:
    """Pairs of two pieces of a bucket that are of different components and whose bitmaps allow the threshold."""
    table = table.combine_chunks().sort_by("n")
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    piece, n = table["piece"].to_numpy(), table["n"].to_numpy()
    root = table["root"].combine_chunks().dictionary_encode().indices.to_numpy()
    bits = [np.frombuffer(x.as_buffer(), _U) for x in table["bits"].combine_chunks()]
    words = np.fromiter(map(len, bits), np.int64, len(bits))
    left, right = np.flatnonzero(piece == i), np.flatnonzero(piece == j)
    out = [np.empty((2, 0), np.int64)]
    for start in range(0, len(left), 64):
        a = left[start : start + 64]
        b = right[np.searchsorted(n[right], n[a[0]] * PERCENT // 100) : np.searchsorted(n[right], n[a[-1]] * 100 // PERCENT, "right")]
        if (root[a] == root[a[0]]).all():
            b = b[root[b] != root[a[0]]]
        if not len(b):
            continue
        width = min(words[a].min(), words[b].min())
        x, y = (np.stack([np.bitwise_xor.reduce(bits[k].reshape(-1, width), axis=0) for k in rows], axis=1) for rows in (a, b))
        apart = np.zeros((len(a), len(b)), np.int32)
        for k in range(width):
            apart += np.bitwise_count(x[k][:, None] ^ y[k])
        na, nb = n[a][:, None], n[b][None, :]
        keep = (apart * (100 + PERCENT) <= (na + nb) * (100 - PERCENT)) & (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * PERCENT)
        keep &= root[a][:, None] != root[b]
        if i == j:
            keep &= a[:, None] < b
        p, q = np.nonzero(keep)
        out.append(np.stack([a[p], b[q]]))
    p, q = np.concatenate(out, axis=1)
    node = table["node"].combine_chunks()
    place = np.empty(len(node), np.int64)
    place[pa.compute.sort_indices(node).to_numpy()] = np.arange(len(node))
    turned = place[p] > place[q]
    p, q = np.where(turned, q, p), np.where(turned, p, q)
    return pa.table({"a": node.take(pa.array(p)), "b": node.take(pa.array(q))})


def remaining(placed: DataFrame, sets: DataFrame) -> DataFrame | None:
    """All distinct pairs ``a``, ``b`` of different components in open buckets that may reach the threshold.

    The members of a bucket's largest component meet only the others. Pieces of a bucket meet in
    tasks of their own, so no task holds more than two of them.
    """
    parts = placed.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"))
    parts = parts.groupBy("h").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("members"), F.count(F.lit(1)).alias("parts"))
    unsure, n_unsure = common.stored_counted(common.lookup(placed, parts.where("parts > 1").drop("parts"), ["h"], "inner"))
    if not n_unsure:
        return None
    small = unsure.where(F.col("members") <= SMALL).select("h", "node", "n", "root")
    other = small.select("h", F.col("root").alias("other"), F.struct("node", "n").alias("centre"))
    pairs = small.join(other, "h").where((F.col("root") != F.col("other")) & (F.col("node") < F.col("centre.node")) & may_link("centre"))
    pairs = pairs.select(F.col("node").alias("a"), F.col("centre.node").alias("b"))

    pieces = lambda c: F.ceil(c / PIECE).cast("int")
    large = unsure.where(F.col("members") > SMALL).withColumns({
        "others": pieces(F.col("members") - F.col("main.c")), "all": pieces(F.col("members") - F.col("main.c")) + pieces(F.col("main.c"))})
    draw = F.xxhash64("h", "node")
    piece = F.when(F.col("root") != F.col("main.root"), F.pmod(draw, F.col("others"))).otherwise(
        F.col("others") + F.pmod(draw, F.col("all") - F.col("others"))).cast("int")
    large = large.select("h", "node", "n", "root", "others", "all", piece.alias("piece"))
    bits = sets.join(large.select("node"), "node", "left_semi").select("node", "items").mapInArrow(_bitmap_rows, "node binary, bits binary")
    p, k = F.col("piece"), F.col("others")
    above = F.when(p < k, F.transform(F.sequence(p, F.col("all") - 1), lambda j: F.struct(p.alias("i"), j.alias("j"))))
    below = F.transform(F.filter(F.sequence(F.lit(0), F.least(p, k - 1)), lambda i: i < p), lambda i: F.struct(i.alias("i"), p.alias("j")))
    met = common.lookup(large, bits, ["node"], "inner").select(
        "h", "node", "n", "root", "piece", "bits", F.explode(F.concat(F.coalesce(above, F.array().cast("array<struct<i:int,j:int>>")), below)).alias("at"))
    met = met.select("h", "at.i", "at.j", "node", "n", "root", "piece", "bits")
    return pairs.union(met.groupBy("h", "i", "j").applyInArrow(_close_pairs, "a binary, b binary")).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id``, ``th`` (hash of the text), ``n`` (set size) and ``component`` (an id)."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    rows = common.stored(keyed.mapInArrow(_signature_rows, "id long, th long, n long, node binary, bands array<long>"))

    first = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    nodes = common.stored(rows.where("node is not null").groupBy("node").agg(
        F.min(first).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")))

    members = nodes.select("node", "n", F.explode("bands").alias("h"))
    buckets = members.groupBy("h").agg(F.min(F.struct("node", "n")).alias("centre"), F.count(F.lit(1)).alias("members"))
    members = common.stored(common.lookup(members, buckets.where("members > 1").drop("members"), ["h"], "inner"))

    nearest = members.where(may_link("centre")).groupBy("node").agg(F.min("centre.node").alias("a"))
    tried, n_tried = common.stored_counted(nearest.select("a", F.col("node").alias("b")))  # one centre each to begin with
    if not n_tried:
        return _result(rows, nodes, None)
    sets = shingle_sets(keyed, nodes, members)
    links, n_links = common.stored_counted(verified(tried, sets))
    roots = components(links) if n_links else None
    turn = 0
    while True:
        turn += 1
        placed = with_roots(members, roots)
        drawn = [F.min(F.struct(F.xxhash64(F.lit(turn), F.lit(k), "h", "node").alias("luck"), "node", "n", "root")) for k in range(CENTRES)]
        mixed = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.array(*drawn).alias("centres"))
        unsure = common.lookup(placed, mixed.where("lo != hi").select("h", "centres"), ["h"], "inner")
        untried, n_untried = common.stored_counted(candidates(unsure).join(tried, ["a", "b"], "left_anti"))
        n_new = 0
        if n_untried:
            tried = tried.union(untried)
            new, n_new = common.stored_counted(verified(untried, sets))
        if n_new:
            links = links.union(new)
            roots = components(links)
        if n_new * PAYS <= n_untried:
            break
    rest = remaining(with_roots(members, roots), sets)
    if rest is not None:
        new, n_new = common.stored_counted(verified(rest.join(tried, ["a", "b"], "left_anti"), sets))
        if n_new:
            roots = components(links.union(new))
    return _result(rows, nodes, roots)


def with_roots(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members of buckets (``h``, ``node``, ``n``) with the ``root`` of their component."""
    if roots is None:
        return members.drop("centre").withColumn("root", F.col("node"))
    return members.drop("centre").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def may_link(centre: str) -> Column:
    """Two different nodes whose sizes allow the threshold."""
    n, m = F.col("n"), F.col(f"{centre}.n")
    return (F.col("node") != F.col(f"{centre}.node")) & (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT)


def candidates(members: DataFrame) -> DataFrame:
    """Distinct pairs of a member of a bucket and its centres that are in other components."""
    n, node, root = F.col("n"), F.col("node"), F.col("root")
    wanted = F.filter("centres", lambda c: (c["root"] != root) & (c["node"] != node) & (F.least(n, c["n"]) * 100 >= F.greatest(n, c["n"]) * PERCENT))
    rows = members.select("node", F.explode(wanted).alias("centre"))
    return rows.select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b")).distinct()


def _result(rows: DataFrame, nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Smallest id of every row's component; rows without shingles stand alone."""
    placed = nodes.select("node", "first").withColumn("root", F.col("node"))
    if roots is not None:
        placed = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = placed.groupBy("root").agg(F.min("first").alias("best"))
    of_node = common.stored(common.lookup(placed, best, ["root"]).select("node", "best"))
    out = common.lookup(rows.drop("bands"), of_node, ["node"])
    alone = F.col("best").isNull()
    return out.select("id", "th", "n", F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("component"),
                      F.when(alone, F.col("th")).otherwise(F.col("best.th")).alias("keeper"))


def shingle_sets(keyed: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Full shingle sets of all nodes that share a bucket, from one document of each."""
    wanted = nodes.select("node", F.col("first.id").alias("id"), F.col("first.th").alias("th")).join(members.select("node"), "node", "left_semi")
    wanted, n_wanted = common.stored_counted(wanted)
    texts = common.join_checked(keyed, wanted, ["id", "th"], "inner", n_wanted).select("node", "text")
    sets = texts.mapInArrow(_set_rows, "node binary, items binary")
    return common.stored(sets.groupBy("node").agg(F.first("items").alias("items")))  # repeated rows: once


def kept_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group (the smallest id), with its own columns only."""
    found = near_duplicates(docs, id, text)
    gone, n_gone = common.stored_counted(found.where(~(F.col("id").eqNullSafe(F.col("component")) & (F.col("th") == F.col("keeper"))))
                         .select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct())
    tag = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    out = common.join_checked(docs.withColumns({"_id": F.col(id).cast("long"), "_th": tag}), gone, ["_id", "_th"], "left_anti", n_gone)
    return out.select(*docs.columns)
