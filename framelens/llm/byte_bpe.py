"""Byte-level BPE encoding and decoding with a ranks file.

Pre-tokens are merged with a queue by rank: linked lists of positions, the rank of the pair that
starts at each, and bitmaps whose first set bits give the lowest rank with entries. A merge pushes
the two new pairs around it. The distinct pre-tokens of a block share one queue: a bitmap marks
the spans of 4096 ranks with entries, and in the lowest span two bitmaps of 64 bits per pre-token
give its lowest rank, so every pre-token merges its own next pair in the same array operation.
Long pre-tokens have a queue of their own, with one bucket of positions per rank and stale entries
skipped when popped, so one of n bytes costs O(n log n) and bytes are never re-scanned.

Texts are encoded a few megabytes at a time: they are cut at single spaces where the pattern always
cuts, and each distinct piece of the block is encoded once.

Defined results: a null or empty text has no tokens; every byte has a rank, so every text can be
encoded and decoding returns its exact bytes; repeated rows and null ids are rows like others.
"""

from __future__ import annotations

import base64
import re
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame

from framelens.llm import ragged

SPACE_CLASS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE_CLASS}]", c))
# Letters of the Latin blocks, on which all versions of Unicode agree.
LATIN = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
BLOCK_BYTES = 4 << 20
QUEUE_BYTES = 1 << 20
LONG = 256
SPAN = 12


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 and number."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(name) as f:
        lines = f.read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


class PairRanks:
    """Ranks of the pairs of tokens that form a token, in a table with open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        self.width = max(ranks.values()) + 2  # the last number is no token
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    found[left * self.width + right] = rank
        size = max(10, (4 * len(found)).bit_length())
        self.shift, self.mask = np.uint64(64 - size), (1 << size) - 1
        self.keys, self.ranks = np.full(1 << size, -1, np.int64), np.full(1 << size, -1, np.int64)
        keys, values = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several for one slot, one stays
            stays = self.keys[slots] == keys
            self.ranks[slots[stays]] = values[stays]
            keys, values, slots = keys[~stays], values[~stays], (slots[~stays] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for none."""
        keys = left * self.width + right
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.ranks[slots], -1)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & self.mask
            held = self.keys[slots[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = self.ranks[slots[rest[hit]]]
            rest = rest[~hit & (held >= 0)]
        return out


def _heads(owners: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.concatenate([[0], np.flatnonzero(owners[1:] != owners[:-1]) + 1])


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        most = max(ranks.values()) + 1
        spelled = [None] * most
        for token, rank in ranks.items():
            spelled[rank] = token
        self.spelled = pa.array(spelled, pa.large_binary())
        self.pair_ranks = PairRanks(ranks)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.low = [0] * (most // 64 + 1)  # all zero between calls
        spaced = pattern.replace("[^\\s", f"[^{SPACE_CLASS}").replace("\\S", f"[^{SPACE_CLASS}]").replace("\\s", f"[{SPACE_CLASS}]")
        self.split = regex.compile(spaced).findall
        self.unsafe = f"[{SPACES}] (?:[{SPACES}]|\\z)"
        self.cut = re.compile(f"(?<=[^{SPACE_CLASS}])(?= [^{SPACE_CLASS}])").split
        # A run of letters and a space before it are one match: plain words, with or without a mark behind, need no pattern.
        self.plain = f"\\A ?[{LATIN}]+[.,]?\\z" if "| ?\\p{L}+|" in pattern else "[^\\x{0}-\\x{10FFFF}]"

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token, by a queue of its pairs.

        ``buckets`` holds the positions of the pairs of each rank; bit r of ``low``, of 64-bit
        words, marks a rank with entries, and ``top`` the words of ``low`` with a bit, so the
        lowest rank is twice the first set bit.
        """
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n, low, top = len(piece), self.low, 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        current = [-1] * n  # rank of the pair that starts here; -1: none
        buckets: dict[int, list[int]] = {}
        changed = zip(range(n - 1), range(2, n + 1))
        while True:
            for start, end in changed:
                rank = rank_of(piece[start:end])
                if rank is None:
                    current[start] = -1
                    continue
                current[start] = rank
                bucket = buckets.get(rank)
                if bucket:
                    heappush(bucket, start)
                    continue
                buckets[rank] = [start]
                word = rank >> 6
                if not low[word]:
                    top |= 1 << word
                low[word] |= 1 << (rank & 63)
            at = -1
            while top:
                lowest = top & -top
                word = lowest.bit_length() - 1
                bits = low[word]
                first = bits & -bits
                rank = (word << 6) + first.bit_length() - 1
                bucket = buckets[rank]
                found = heappop(bucket) if len(bucket) > 1 else bucket.pop()
                if not bucket:
                    low[word] = bits ^ first
                    if bits == first:
                        top ^= lowest
                if current[found] == rank:  # else stale: the pair here has changed
                    at = found
                    break
            if at < 0:
                break
            gone = after[at]
            end = after[gone]
            after[at] = end
            current[gone] = current[at] = -1
            changed = []
            if end < n:
                before[end] = at
                changed.append((at, after[end]))
            if before[at] >= 0:
                changed.append((before[at], end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def merge_all(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids, and how many, of pre-tokens given by their joined bytes and sizes (none is 0).

        A position that starts no token any more, and the one behind the last, has no pair.
        """
        n, ends = len(data), np.cumsum(sizes)
        word = np.repeat(np.arange(len(sizes)), sizes)
        token = np.append(self.of_byte[data], self.pair_ranks.width - 1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = before[ends - sizes] = n
        current = np.append(self.pair_ranks(token[:n], token[after[:n]]), -1)
        starts_token, top = np.ones(n, bool), 0

        def marked(ranks):
            return sum(1 << int(s) - 1 for s in np.flatnonzero(np.bincount((ranks >> SPAN) + 1)) if s)

        top = marked(current)
        while top:
            lowest = top & -top
            span = lowest.bit_length() - 1
            queue = np.flatnonzero(current >> SPAN == span)
            while len(queue) and not top & (lowest - 1):
                at, rank, owner = queue, current[queue], word[queue]
                heads = _heads(owner)
                for level in (6, 0):
                    bits = np.uint64(1) << (rank >> level & 63).astype(np.uint64)
                    low = np.bitwise_or.reduceat(bits, heads)
                    low &= ~low + np.uint64(1)
                    first = bits == np.repeat(low, np.diff(heads, append=len(at)))
                    at, rank, owner = at[first], rank[first], owner[first]
                    heads = _heads(owner)
                at, merged = at[heads], rank[heads]  # the leftmost pair of the lowest rank
                gone, left = after[at], before[at]
                end = after[gone]
                token[at], after[at], before[end] = merged, end, at
                starts_token[gone] = False
                current[gone] = -1
                current[at] = behind = self.pair_ranks(merged, token[end])
                current[left] = ahead = self.pair_ranks(token[left], merged)
                current[n] = -1
                top |= marked(behind) | marked(ahead)
                queue = np.sort(np.concatenate([queue, left]), kind="stable")
                queue = queue[(current[queue] >> SPAN == span) & np.append(queue[1:] != queue[:-1], True)]
            if not len(queue):
                top &= ~lowest
        return token[:n][starts_token], np.add.reduceat(starts_token, ends - sizes, dtype=np.int64)

    def _merged(self, words: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """Ids of distinct pre-tokens (none is empty) as little-endian unsigned 32-bit integers."""
        starts, data = ragged.raw(words)
        sizes, data = np.diff(starts), np.frombuffer(data, np.uint8)
        whole = pc.index_in(words, value_set=self.spelled)
        ids = pc.fill_null(whole, 0).to_numpy(zero_copy_only=False).astype("<u4")
        counts = np.ones(len(words), np.int64)
        rest = np.flatnonzero(whole.is_null().to_numpy(zero_copy_only=False))
        short, tokens, owners = rest[sizes[rest] <= LONG], [], []
        while len(short):  # one queue for about a megabyte of pre-tokens
            some = max(1, int(np.searchsorted(np.cumsum(sizes[short]), QUEUE_BYTES, "right")))
            own, short = short[:some], short[some:]
            n = sizes[own]
            found, counts[own] = self.merge_all(data[ragged.spread(starts[own], n)], n)
            tokens.append(found)
            owners.append(own)
        for own in rest[sizes[rest] > LONG].tolist():
            tokens.append(self.merge(data[starts[own] : starts[own + 1]].tobytes()))
            owners.append([own])
            counts[own] = len(tokens[-1])
        ends = ragged.starts(counts)
        out = np.empty(ends[-1], "<u4")
        out[ends[:-1]] = ids
        for own, found in zip(owners, tokens):
            n = counts[own]
            out[ragged.spread(ends[own], n)] = found
        return ragged.binaries(ends * 4, out)

    def _pieces(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of distinct pieces of text between two cuts."""
        plain = pc.match_substring_regex(pieces, self.plain)
        words = pieces.filter(plain)
        marked = pc.match_substring_regex(words, "[.,]\\z")
        marks = pc.utf8_slice_codeunits(words.filter(marked), -1)
        words = pc.replace_substring_regex(words, "[.,]\\z", "")
        others = [self.split(x) for x in pieces.filter(pc.invert(plain)).to_pylist()]
        where, marked = np.flatnonzero(plain), np.flatnonzero(marked)
        counts = np.ones(len(pieces), np.int64)
        counts[where[marked]] = 2
        behind = np.ones(len(pieces), bool)
        behind[where] = False
        counts[behind] = n = np.fromiter(map(len, others), np.int64, len(others))
        found = pa.concat_arrays([words, marks, pa.array([w for x in others for w in x], pa.large_string())]).dictionary_encode()
        index, ends = found.indices.to_numpy(), ragged.starts(counts)
        order = np.empty(ends[-1], np.int64)
        order[ends[where]] = index[: len(words)]
        order[ends[where[marked]] + 1] = index[len(words) : len(words) + len(marks)]
        order[ragged.spread(ends[:-1][behind], n)] = index[len(words) + len(marks) :]
        starts, ids = ragged.raw(self._merged(found.dictionary.cast(pa.large_binary())).take(pa.array(order)))
        return ragged.binaries(starts[ends], ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) one after another, and where those of each begin, and the end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        unsafe = pc.match_substring_regex(texts, self.unsafe)  # a run of white space before or behind a cut
        cuts = [self.cut(x) for x in texts.filter(unsafe).to_pylist()]
        between = pc.split_pattern(texts.filter(pc.invert(unsafe)), " ")
        unsafe = np.asarray(unsafe)
        counts = np.empty(len(texts), np.int64)
        counts[unsafe] = n = np.fromiter(map(len, cuts), np.int64, len(cuts))
        counts[~unsafe] = pc.list_value_length(between)
        own, rest = ragged.starts(counts), between.flatten()
        firsts = ragged.starts(counts[~unsafe])[:-1]
        led = rest.dictionary_encode()  # a space stands before them
        bare = pa.concat_arrays([rest.take(pa.array(firsts)), pa.array([w for x in cuts for w in x], pa.large_string())]).dictionary_encode()
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), led.dictionary, pa.scalar(" ", pa.large_string()))
        pieces = pa.concat_arrays([spaced, bare.dictionary])
        index, other = led.indices.to_numpy().astype(np.int64), bare.indices.to_numpy() + len(spaced)
        index[firsts] = other[: len(firsts)]
        order = np.empty(own[-1], np.int64)
        cut = np.repeat(unsafe, counts)
        order[~cut], order[cut] = index, other[len(firsts) :]
        starts, ids = ragged.raw(self._pieces(pieces).take(pa.array(order)))
        return np.frombuffer(ids, "<u4"), starts[own] // 4

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
        """The bytes that ids stand for, joined, and where those of each begin, and the end."""
        found = self.spelled.take(pa.array(ids))
        if found.null_count:
            raise KeyError("ids without a token")
        return ragged.raw(found)

    def parts(self, text: str) -> list[bytes]:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return [self.encode(pa.array([text]))[0].tobytes()]

    def decoded(self, parts: list[bytes]) -> bytes:
        """The bytes that the ids stand for."""
        return bytes(self.decode(np.frombuffer(b"".join(parts), "<u4"))[1])


@cache
def codec(path: str, pattern: str) -> Codec:
    """One per worker process."""
    return Codec(load_ranks(path), pattern)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _digests(own: Codec, key: pa.Array, ids: np.ndarray, starts: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Number of ids, and SHA-256 of the ids and of the bytes they decode to."""
    import hashlib

    raw, (ends, text) = memoryview(ids.astype("<u4", copy=False)).cast("B"), own.decode(ids)
    bounds = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
    sums = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in bounds]
    places = ends[starts].tolist()
    texts = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(places, places[1:])]
    return pa.RecordBatch.from_arrays([key, pa.array(np.diff(starts), pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())], names=names)


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id`` and ``ids`` (array of int) of every text."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    def rows(batches):
        own = codec(ranks, pattern)
        for batch in batches:
            for block in ragged.blocks(batch, 1, BLOCK_BYTES):
                ids, starts = own.encode(block.column(1))
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([block.column(0), lists], names=[id, "ids"])

    return docs.select(id, text).mapInArrow(rows, f"`{id}` {dict(docs.dtypes)[id]}, ids array<int>")


def decode(tokens: DataFrame, id: str = "doc_id", ids: str = "ids", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id``, ``ids`` and ``bytes`` (the exact bytes of the text)."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    def rows(batches):
        own = codec(ranks, pattern)
        for batch in batches:
            found, starts = ragged.lists(batch.column(1))
            ends, text = own.decode(found)
            out = ragged.binaries(ends[starts], text).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], names=[id, "ids", "bytes"])

    return tokens.select(id, ids).mapInArrow(rows, f"`{id}` {dict(tokens.dtypes)[id]}, ids array<int>, bytes binary")


def round_trip(docs: DataFrame, id: str = "doc_id", text: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """As ``digests(encode(docs))`` in one pass over blocks of texts."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    def rows(batches):
        own = codec(ranks, pattern)
        for batch in batches:
            for block in ragged.blocks(batch, 1, BLOCK_BYTES):
                yield _digests(own, block.column(0), *own.encode(block.column(1)), [id, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id, text).mapInArrow(rows, f"`{id}` {dict(docs.dtypes)[id]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digests(tokens: DataFrame, id: str = "doc_id", ids: str = "ids", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``n_tokens``, and SHA-256 of the ids (little-endian) and of the bytes they decode to."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    def rows(batches):
        own = codec(ranks, pattern)
        for batch in batches:
            yield _digests(own, batch.column(0), *ragged.lists(batch.column(1)), [id, "n_tokens", "ids_sha256", "decoded_sha256"])

    return tokens.select(id, ids).mapInArrow(rows, f"`{id}` {dict(tokens.dtypes)[id]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
