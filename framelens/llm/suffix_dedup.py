"""Removal of repeated byte strings by sorting suffixes.

Every byte that a string of ``LENGTH`` bytes covers is removed when that string also starts in a
document with a smaller id. Sorting every suffix of the corpus in one place is out of the question,
so suffixes are dealt out by content: the smallest hash among the 24-byte strings inside a window
of ``LENGTH`` bytes is the key of the window, and equal windows have equal keys. Neighbouring
windows with one key form a run, about one per 14 bytes.

1. Documents are packed into chunks. Of each chunk, short forms of its keys go to the bucket of the
   key; the bucket answers with a bit per key: seen in another document or not.
2. Runs with such keys go to their bucket with the bytes they cover; equal runs of a chunk go once,
   from the smallest document, as all others are repeats already.
3. A bucket sorts the suffixes that start at windows: multikey quicksort by words of 8 bytes down to
   ``SHALLOW`` bytes, then blind tries order the groups that are still equal. A trie node looks at
   the one byte where its group first differs; leaves are groups of equal strings. In each leaf,
   windows of documents above the smallest id are repeats.
4. The covered intervals return to the chunks and are cut out.

The number of buckets follows the size of the input. Every task holds one chunk or one bucket.

Defined results: a null text is empty; texts shorter than ``LENGTH`` bytes keep everything; null
ids count as larger than all others and equal to each other; rows with equal ids never remove
each other; texts of any size are handled in segments; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from framelens.llm import common
from framelens.llm.near_dups import mix
from framelens.session import shared_folder

LENGTH = 50
GRAM = 24
SHALLOW = 24
CHUNK_BYTES = 2 << 20
SEGMENT = 1 << 20
BUCKET_BYTES = 8 << 20
SHORT = 39  # bits of a key that are sent, besides its bucket
LAST = np.iinfo(np.int64).max
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


def window_keys(data: np.ndarray) -> np.ndarray:
    """Key of the window that starts at each place where a whole window fits."""
    h, size, factor, steps = data.astype(_U) + _U(1), 1, _BASE, {}
    while size <= 16:
        steps[size] = h, factor
        h = h[:-size] * _U(factor) + h[size:] if len(h) > size else h[:0]
        factor, size = factor * factor & _WRAP, size * 2
    (eight, power), (sixteen, _) = steps[8], steps[16]  # 24 = 16 + 8
    n = len(data) - GRAM + 1
    low = mix(sixteen[:n] * _U(power) + eight[16 : 16 + n])
    width, size = LENGTH - GRAM + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(data) - LENGTH + 1], low[width - size : width - size + len(data) - LENGTH + 1])


class Runs:
    """Runs of windows with one key in a chunk: document, start and end of the bytes covered."""

    def __init__(self, ends: np.ndarray, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        keys, docs, starts, stops = [], [], [], []
        begin = 0
        for doc, end in enumerate(ends):
            for at in range(begin, max(begin, end - LENGTH + 1), SEGMENT):
                k = window_keys(raw[at : min(end, at + SEGMENT + LENGTH - 1)])
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                keys.append(k[first])
                docs.append(np.full(len(first), doc, np.int32))
                starts.append(first + at)
                stops.append(np.append(first[1:], len(k)) - 1 + LENGTH + at)
            begin = end
        join = lambda parts, t: np.concatenate(parts) if parts else np.empty(0, t)
        self.key, self.doc = join(keys, _U), join(docs, np.int32)
        self.start, self.stop = join(starts, np.int64), join(stops, np.int64)

    def codes(self, buckets: int) -> np.ndarray:
        """Bucket and short form of each key; the bucket is in the high bits."""
        return ((self.key % _U(buckets)) << _U(SHORT)) | ((self.key // _U(buckets)) & _U((1 << SHORT) - 1))


def _chunks(batches):
    """Rows of whole documents, sorted by id inside a chunk."""
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def chunk():
        held.sort(key=lambda x: x[0])
        ids = pa.array([None if i == LAST else i for i, _ in held], pa.int64())
        ends = np.cumsum([len(t) for _, t in held])
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        return pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | number], pa.int64()), one(ids), one(pa.array(ends, pa.int64())), pa.array([b"".join(t for _, t in held)], pa.binary())],
            names=["chunk", "ids", "ends", "data"])

    for batch in batches:
        for id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.append((LAST if id is None else id, text.as_buffer().to_pybytes() if text.is_valid else b""))
            size += len(held[-1][1])
            if size >= CHUNK_BYTES or len(held) >= 20_000:
                yield chunk()
                number, held, size = number + 1, [], 0
    if held:
        yield chunk()


def _each(batches):
    """Chunk, ids, ends and bytes of every row, and the whole row."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column(1)[i].values.fill_null(LAST).to_numpy(zero_copy_only=False)
            yield batch.column(0)[i].as_py(), ids, batch.column(2)[i].values.to_numpy(), batch.column(3)[i].as_buffer().to_pybytes(), batch.slice(i, 1)


def _by_bucket(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """Bucket, first and last place of each bucket in sorted codes."""
    bucket = (codes >> _U(SHORT)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(bucket)])]


def _key_rows(buckets: int):
    def rows(batches):
        for chunk, ids, ends, data, _ in _each(batches):
            runs = Runs(ends, data)
            codes, back = np.unique(runs.codes(buckets), return_inverse=True)
            owner = ids[runs.doc]
            lo, hi = np.full(len(codes), LAST), np.full(len(codes), np.iinfo(np.int64).min)
            np.minimum.at(lo, back, owner)
            np.maximum.at(hi, back, owner)
            short = (codes & _U((1 << SHORT) - 1)) << _U(1) | (lo != hi).astype(_U)
            packed = short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            cuts = _by_bucket(codes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _, _ in cuts], pa.int64()), pa.array([chunk] * len(cuts), pa.int64()),
                 pa.array([packed[x:y].tobytes() for _, x, y in cuts], pa.binary())], names=["bucket", "chunk", "keys"])
    return rows


def _live(table: pa.Table) -> pa.Table:
    """A bit per key of a bucket: does another document, here or in another chunk, have it?"""
    parts = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 5) for x in table.column("keys")]
    sizes = [len(p) for p in parts]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :5] = np.concatenate(parts)
    short = wide.view("<u8").reshape(-1)
    _, back, seen = np.unique(short >> _U(1), return_inverse=True, return_counts=True)
    several = np.zeros(len(seen), bool)
    several[back[(short & _U(1)) == 1]] = True
    bits = (several | (seen > 1))[back]
    out, at = [], 0
    for n in sizes:
        out.append(np.packbits(bits[at : at + n]).tobytes())
        at += n
    return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "live": pa.array(out, pa.binary())})


def _run_rows(buckets: int):
    def rows(batches):
        for chunk, ids, ends, data, row in _each(batches):
            answers = {x["bucket"]: x["live"] for x in row.column(4)[0].as_py() or []}
            runs = Runs(ends, data)
            all_codes = runs.codes(buckets)
            codes = np.unique(all_codes)
            flags = np.zeros(len(codes), bool)
            for b, x, y in _by_bucket(codes):
                if b in answers:
                    flags[x:y] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=y - x).astype(bool)
            live = np.flatnonzero(flags[np.searchsorted(codes, all_codes)])
            first: dict[bytes, int] = {}
            send, repeats = [], []
            for i, a, z, doc in zip(live.tolist(), runs.start[live].tolist(), runs.stop[live].tolist(), ids[runs.doc[live]].tolist()):
                owner = first.setdefault(data[a:z], doc)
                (send if owner == doc else repeats).append(i)
            send, repeats = np.array(send, np.int64), np.array(repeats, np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            own, local = _groups(all_codes[send]), _groups(all_codes[repeats])
            names = sorted({*own, *local})
            pick = lambda groups, b: groups.get(b, np.empty(0, np.int64))
            sent, known = [send[pick(own, b)] for b in names], [repeats[pick(local, b)] for b in names]
            place = lambda idx, ends_at: (ends_at[idx] - begins[runs.doc[idx]]).tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array(names, pa.int64()), pa.array([chunk] * len(names), pa.int64()),
                pa.array([ids[runs.doc[s]].tolist() for s in sent], pa.list_(pa.int64())), pa.array([runs.doc[s].tolist() for s in sent], pa.list_(pa.int32())),
                pa.array([place(s, runs.start) for s in sent], pa.list_(pa.int64())), pa.array([(runs.stop[s] - runs.start[s]).tolist() for s in sent], pa.list_(pa.int32())),
                pa.array([b"".join([data[a:z] for a, z in zip(runs.start[s].tolist(), runs.stop[s].tolist())]) for s in sent], pa.binary()),
                pa.array([runs.doc[s].tolist() for s in known], pa.list_(pa.int32())), pa.array([place(s, runs.start) for s in known], pa.list_(pa.int64())),
                pa.array([place(s, runs.stop) for s in known], pa.list_(pa.int64()))], names=_RUN_COLUMNS)
    return rows


_RUN_COLUMNS = ["bucket", "chunk", "owners", "docs", "starts", "sizes", "bytes", "known_docs", "known_starts", "known_stops"]
_RUN_SCHEMA = ("bucket long, chunk long, owners array<long>, docs array<int>, starts array<long>, sizes array<int>, bytes binary, "
               "known_docs array<int>, known_starts array<long>, known_stops array<long>")


def _groups(codes: np.ndarray) -> dict[int, np.ndarray]:
    """Places by bucket."""
    order = np.argsort(codes, kind="stable")
    return {b: order[x:y] for b, x, y in _by_bucket(codes[order])}


def _word(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes of the text from each place, as a big-endian number."""
    out = np.zeros(len(at), _U)
    for k in range(8):
        out = (out << _U(8)) | text[at + k]
    return out


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """Number of the group of equal keys, for rows sorted by them."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _several(group: np.ndarray) -> np.ndarray:
    """Members of groups with at least two."""
    return np.bincount(group)[group] > 1 if len(group) else np.empty(0, bool)


def equal_suffixes(text: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose first ``LENGTH`` bytes are found again, and the number of their string.

    The text needs eight spare bytes at its end. Strings are numbered in sorted order per level.
    """
    group = np.zeros(len(suffixes), np.int64)
    for depth in range(0, SHALLOW, 8):  # multikey quicksort: equal parts go on with the next word
        word = _word(text, suffixes + depth)
        order = np.lexsort((word, group)) if depth else np.argsort(word, kind="stable")
        suffixes, group, word = suffixes[order], group[order], word[order]
        group = _numbered(group, word)
        keep = _several(group)
        suffixes, group = suffixes[keep], group[keep]
    found, names, next_name, depth = [], [], 0, np.full(len(suffixes), SHALLOW, np.int64)
    while len(suffixes):  # one level of all blind tries
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        count = np.diff(np.append(heads, len(group)))
        branch = np.minimum.reduceat(_mismatch(text, suffixes, np.repeat(suffixes[heads], count), depth), heads)
        leaf = np.repeat(branch >= LENGTH, count)
        if leaf.any():
            found.append(suffixes[leaf])
            numbers = _numbered(group[leaf]) + next_name
            names.append(numbers)
            next_name = int(numbers[-1]) + 1
        suffixes, group, depth = suffixes[~leaf], group[~leaf], np.repeat(branch, count)[~leaf]
        byte = text[suffixes + depth] if len(suffixes) else np.empty(0, np.uint8)
        order = np.lexsort((byte, group))
        suffixes, depth, byte, group = suffixes[order], depth[order] + 1, byte[order], group[order]
        group = _numbered(group, byte) if len(group) else group
        keep = _several(group)
        suffixes, group, depth = suffixes[keep], group[keep], depth[keep]
    empty = np.empty(0, np.int64)
    return (np.concatenate(found), np.concatenate(names)) if found else (empty, empty)


def _mismatch(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First place from ``depth`` on where two strings differ; ``LENGTH`` if they do not."""
    out = np.full(len(a), LENGTH, np.int64)
    for at in range(SHALLOW, LENGTH, 8):
        rest = np.flatnonzero((out == LENGTH) & (a != b) & (depth < at + 8))
        if not len(rest):
            continue
        diff = _word(text, a[rest] + at) ^ _word(text, b[rest] + at)
        skip = np.clip(depth[rest] - at, 0, 7).astype(_U) * _U(8)
        diff = diff & (_U(0xFFFFFFFFFFFFFFFF) >> skip)  # bytes before the depth are known to agree
        some = diff != 0
        value = diff[some]
        lead = np.zeros(len(value), np.int64)
        for k in range(7, 0, -1):
            lead += (value >> _U(8 * k)) == 0
        out[rest[some]] = np.minimum(at + lead, LENGTH)
    return out


def _repeats(table: pa.Table) -> pa.Table:
    """Covered intervals of a bucket's runs, per chunk."""
    flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    owners, docs, starts, sizes = flat("owners"), flat("docs"), flat("starts"), flat("sizes").astype(np.int64)
    per_row = np.array([len(x) for x in table.column("docs")], np.int64)
    row = np.repeat(np.arange(table.num_rows), per_row)
    text = np.frombuffer(b"".join(x.as_py() for x in table.column("bytes")) + bytes(16), np.uint8)
    begin = np.cumsum(sizes) - sizes
    windows = sizes - LENGTH + 1
    run = np.repeat(np.arange(len(sizes)), windows)
    suffixes = begin[run] + (np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows))
    run_of = np.zeros(len(text), np.int32)
    run_of[suffixes] = run
    same, name = equal_suffixes(text, suffixes)
    stay_docs, stay_starts, stay_stops = ([[] for _ in range(table.num_rows)] for _ in range(3))
    if len(same):
        owner = owners[run_of[same]]
        least = np.full(int(name.max()) + 1, LAST)
        np.minimum.at(least, name, owner)
        hit = np.sort(same[owner > least[name]])
        if len(hit):
            r = run_of[hit]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(r) != 0)]))
            last = np.append(first[1:], len(hit)) - 1
            r = r[first]
            lo, hi = starts[r] + hit[first] - begin[r], starts[r] + hit[last] - begin[r] + LENGTH
            for i, d, x, y in zip(row[r].tolist(), docs[r].tolist(), lo.tolist(), hi.tolist()):
                stay_docs[i].append(d)
                stay_starts[i].append(x)
                stay_stops[i].append(y)
    extend = lambda name, own: pa.array([[*(a.as_py() or []), *b] for a, b in zip(table.column(name), own)], table.schema.field(name).type)
    return pa.table({"chunk": table.column("chunk"), "docs": extend("known_docs", stay_docs), "starts": extend("known_starts", stay_starts),
                     "stops": extend("known_stops", stay_stops)})


def _merged(table: pa.Table) -> pa.Table:
    """Maximal removed runs of the documents of one chunk."""
    flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    docs, starts, stops = flat("docs"), flat("starts"), flat("stops")
    order = np.lexsort((starts, docs))
    out: list[list[int]] = []
    for d, a, z in zip(docs[order].tolist(), starts[order].tolist(), stops[order].tolist()):
        if out and out[-1][0] == d and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], z)
        else:
            out.append([d, a, z])
    columns = list(zip(*out)) or [(), (), ()]
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "docs": pa.array([columns[0]], pa.list_(pa.int32())),
                     "starts": pa.array([columns[1]], pa.list_(pa.int64())), "stops": pa.array([columns[2]], pa.list_(pa.int64()))})


def _kept(batches):
    """Per document: sizes, spans and the bytes that stay."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, ends = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            data = batch.column(3)[i].as_buffer().to_pybytes()
            spans: dict[int, list] = {}
            for d, a, z in zip(*(batch.column(c)[i].as_py() or [] for c in (4, 5, 6))):
                spans.setdefault(d, []).append((a, z))
            out, begin = [], 0
            for d, (id, end) in enumerate(zip(ids, ends)):
                text, at, parts = data[begin:end], 0, []
                for a, z in spans.get(d, ()):
                    parts.append(text[at:a])
                    at = z
                kept = b"".join([*parts, text[at:]])
                out.append((id, len(text), len(text) - len(kept), len(spans.get(d, ())), kept))
                begin = end
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3)), pa.array([x[4] for x in out], pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def drop_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary) of every document."""
    spark = docs.sparkSession
    seen, path = Observation(), shared_folder(spark)
    packed = docs.select(F.col(id).cast("long"), text).mapInArrow(_chunks, "chunk long, ids array<long>, ends array<long>, data binary")
    packed.observe(seen, F.sum(F.length("data").cast("long")).alias("bytes")).write.options(
        **{"compression": "zstd", "parquet.block.size": str(8 << 20)}).parquet(path)
    chunks = spark.read.schema(packed.schema).parquet(path)
    size = seen.get["bytes"] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))

    keys = chunks.mapInArrow(_key_rows(buckets), "bucket long, chunk long, keys binary")
    live = keys.groupBy("bucket").applyInArrow(_live, "bucket long, chunk long, live binary")
    live = common.stored(live.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "live")).alias("answers")))
    small = size // 64 <= common.BROADCAST_BYTES  # a bit per run and a header per bucket and chunk
    asked = chunks.join(F.broadcast(live) if small else live, "chunk", "left")
    runs = asked.select("chunk", "ids", "ends", "data", "answers").mapInArrow(_run_rows(buckets), _RUN_SCHEMA)
    found = runs.groupBy("bucket").applyInArrow(_repeats, "chunk long, docs array<int>, starts array<long>, stops array<long>")
    spans = common.stored(found.groupBy("chunk").applyInArrow(_merged, "chunk long, docs array<int>, starts array<long>, stops array<long>"))
    small = spans.agg(F.sum(F.size("docs"))).first()[0] or 0
    cut = chunks.join(F.broadcast(spans) if small * 24 <= common.BROADCAST_BYTES else spans, "chunk", "left")
    return cut.select("chunk", "ids", "ends", "data", "docs", "starts", "stops").mapInArrow(
        _kept, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
