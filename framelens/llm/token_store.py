"""Token ids in Parquet that can be read selectively.

Documents are range-partitioned and sorted by id and encoded in that order; each part of the
table holds, per document, its id, length, offset within the part and the list of ids. Ids of
tokens are dictionary-encoded, the increasing numbers delta-encoded (page format 2). Row groups
and pages are small and have column indexes, so a filter on ``doc_id`` reads few pages and
metadata can be read without the lists. The offsets of the parts are one number per part.

Texts are encoded a few megabytes at a time. The tokenizer drops white space and never merges
across it, so each distinct piece between spaces of a block is encoded once. Words of Latin letters
are shared by pieces that differ in case or in the marks behind, as the tokenizer lower-cases them
and cuts them there; the latest ones, and other pieces, are remembered up to a bound.

Defined results: a null or empty text holds the end id only; null ids come first; equal ids are
ordered by a hash of their text, repeated rows by nothing more (they are equal).
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import cache
from unicodedata import category, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm import ragged
from framelens.session import shared_folder

END = 2
REMEMBERED = 180_000
REMEMBERED_WORDS = 300_000
LONGEST = 64
BLOCK_BYTES = 4 << 20
JOINED = 10_000
# Letters of the Latin blocks that normalization keeps and that have one lower-case letter.
LATIN = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1)
MARKS = re.escape("".join(c for c in map(chr, range(33, 127)) if not c.isalnum()))
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "200",
}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ends_in_letter(word: str) -> bool:
    """Whether the word still ends in a letter after the tokenizer's normalization, which may split
    a letter into a base and a mark; a mark would go with the punctuation that follows it."""
    if not word or not word[-1].isalpha():
        return False
    return word.isascii() or category(normalize("NFC", word).lower()[-1])[0] == "L"


class Encoder:
    """Encodes texts piece by piece; pieces in recent use are remembered, in two generations."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words, self.word_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def learn(self, new: set[str]) -> None:
        known, older = self.pieces, self.older
        for p in new & older.keys():
            known[p] = older[p]
        rest = new.difference(known)
        # A comma or full stop after a letter is a token of its own: encode the word without it.
        ended = {p for p in rest if p[-1:] in (",", ".") and ends_in_letter(p[:-1])}
        plain = (rest - ended) | ({p[:-1] for p in ended} | {",", "."}).difference(known)
        letters = [p for p in plain if p.isalpha()]
        if letters:  # one word each, so their ids in one text end where a token ends a word
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            if len(stops) == len(letters):
                raw, start = ids.tobytes(), 0
                for p, stop in zip(letters, stops.tolist()):
                    known[p] = raw[start:stop]
                    start = stop
                plain.difference_update(letters)
        others = list(plain)
        for p, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            known[p] = array("I", e.ids).tobytes()
        for p in ended:
            known[p] = known[p[:-1]] + known[p[-1]]

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, one after another, and how many each has."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        counts = np.diff(np.flatnonzero(self.ends_word[ids]) + 1, prepend=0)
        if len(counts) == len(words):
            return ids, counts
        apart = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate(apart), np.fromiter(map(len, apart), np.int64, len(apart))

    def _latin(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of distinct lower-case words of Latin letters."""
        place = pc.index_in(words, value_set=self.words)
        fresh = np.asarray(place.is_null())
        new = words.filter(pa.array(fresh)).to_pylist()
        found = [self._joined(new[i : i + JOINED]) for i in range(0, len(new), JOINED)]
        ids, counts = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, "<u4"), np.empty(0, np.int64))
        at = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at[fresh] = len(self.words) + np.arange(len(new))
        out = pa.concat_arrays([self.word_ids, ragged.binaries(ragged.starts(counts) * 4, ids)]).take(pa.array(at))
        short = np.flatnonzero(pc.binary_length(words).to_numpy() <= LONGEST)
        unused = np.ones(len(self.words), bool)
        unused[at[~fresh]] = False
        unused = np.flatnonzero(unused)[: max(0, REMEMBERED_WORDS - len(short))]
        short, unused = pa.array(short[:REMEMBERED_WORDS]), pa.array(unused)
        self.words = pa.concat_arrays([words.take(short), self.words.take(unused)])  # recent ones first
        self.word_ids = pa.concat_arrays([out.take(short), self.word_ids.take(unused)])
        return out

    def _pieces(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of distinct pieces between spaces."""
        plain = pc.match_substring_regex(pieces, f"\\A[{LATIN}]+[{MARKS}]*\\z")
        marked = pieces.filter(plain)
        words = pc.utf8_lower(pc.replace_substring_regex(marked, f"[{MARKS}]+\\z", "")).dictionary_encode()
        marks = pc.replace_substring_regex(marked, f"\\A[{LATIN}]+", "").dictionary_encode()
        others = marks.dictionary.to_pylist() + pieces.filter(pc.invert(plain)).to_pylist()
        if len(self.pieces) >= REMEMBERED:
            self.pieces, self.older = {}, self.pieces
        self.learn(set(others).difference(self.pieces))
        known = pa.concat_arrays([self._latin(words.dictionary), pa.array([self.pieces[p] for p in others], pa.large_binary())])
        plain, counts = np.asarray(plain), np.ones(len(pieces), np.int64)
        counts[plain] = 2
        ends = ragged.starts(counts)
        order = np.empty(ends[-1], np.int64)
        order[ends[:-1][plain]] = words.indices
        order[ends[:-1][plain] + 1] = marks.indices.to_numpy() + len(words.dictionary)
        order[ends[:-1][~plain]] = np.arange(len(others) - len(marks.dictionary)) + len(words.dictionary) + len(marks.dictionary)
        starts, ids = ragged.raw(known.take(pa.array(order)))
        return ragged.binaries(starts[ends], ids)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) one after another, and where those of each begin, and the end."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        split = pc.split_pattern(texts, " ")
        pieces = split.flatten().dictionary_encode()
        starts, ids = ragged.raw(self._pieces(pieces.dictionary).take(pieces.indices))
        return np.frombuffer(ids, "<u4"), starts[ragged.starts(pc.list_value_length(split).to_numpy())] // 4

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, starts = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(starts, starts[1:])]


@cache
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END) -> None:
    """Write the token table of ``docs`` to ``path``."""
    model = tokenizer or default_tokenizer()

    def rows(batches):
        own, part, offset = encoder(model), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in ragged.blocks(whole, 1, BLOCK_BYTES):
                ids, ends = own.encode_column(batch.column(1))
                ids = np.insert(ids, ends[1:], end)
                ends += np.arange(len(ends))
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(tokens), part, np.int32)), pa.array(offset + ends[:-1]), pa.array(np.diff(ends)), tokens],
                    names=["doc_id", "part", "part_start", "n_tokens", "tokens"])
                offset += len(ids)

    keyed = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(rows, "doc_id long, part int, part_start long, n_tokens long, tokens array<int>").write.options(**LAYOUT).parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """The stored table with ``start``: ids of all documents before, in the order of ids.

    Only one sum per part reaches the driver.
    """
    stored = spark.read.parquet(path)
    sums = sorted(tuple(r) for r in stored.groupBy("part").agg(F.sum("n_tokens")).collect())
    starts, total = [], 0
    for part, n in sums:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "part int, part_offset long")
    joined = stored.join(F.broadcast(offsets), "part")  # as many rows as parts were written
    return joined.select("doc_id", (F.col("part_offset") + F.col("part_start")).alias("start"), "n_tokens", "tokens")


def checksums(tokens: DataFrame) -> DataFrame:
    """``ids_crc32`` of the stored ids of each document."""

    def rows(batches):
        for batch in batches:
            ids, ends = ragged.lists(batch.column(3))
            raw, ends = memoryview(ids.astype("<i4", copy=False)).cast("B"), (4 * ends).tolist()
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_tokens(docs: DataFrame, **options) -> DataFrame:
    path = shared_folder(docs.sparkSession)
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path)
