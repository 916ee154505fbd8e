"""Blocks of texts: one queue for the new words of a block, equal to the library."""

import random

import numpy as np
import pyarrow as pa
import pytest

from framelens.llm import byte_bpe, token_store

LETTERS = "etaoinshrdlucfmwypvbgkjqxz"


def words(n: int, seed: int = 1) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices(LETTERS + "éßñöABC", k=draw.randint(4, 14))) for _ in range(n)]


def library(ranks: dict, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded(own, texts: list) -> list[list[int]]:
    ids, starts = own.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]


def test_new_words_of_a_block_share_a_queue(monkeypatch):
    """No word of a usual length has a queue of its own, however many a block holds."""
    ranks, pattern = byte_bpe.load_ranks(byte_bpe.default_ranks()), byte_bpe.default_pattern()
    own, tiktoken = byte_bpe.Codec(ranks, pattern), library(ranks, pattern)

    def alone(piece):
        raise AssertionError(f"a queue for {piece} alone")

    monkeypatch.setattr(own, "merge", alone)
    made = words(30_000)
    texts = [" ".join(made[i : i + 100]) for i in range(0, len(made), 100)]
    assert [list(memoryview(b"".join(own.parts(t))).cast("I")) for t in texts[:50]] == [tiktoken.encode_ordinary(t) for t in texts[:50]]
    assert encoded(own, texts) == [tiktoken.encode_ordinary(t) for t in texts]


def test_blocks_hold_any_mix_of_texts():
    ranks, pattern = byte_bpe.load_ranks(byte_bpe.default_ranks()), byte_bpe.default_pattern()
    own, tiktoken = byte_bpe.Codec(ranks, pattern), library(ranks, pattern)
    texts = ["", None, " ", "  ", "a  b", " a ", "a \n b", "word, Word. naïve,\nßtraße.", "\x00 \x1c", "日本語 の 文字。", "a" * 5000 + " " + "ab" * 200,
             "don't we'll 123,456", "    x ", "😀😀 é.", "x." * 300, "a" * 256 + " " + "a" * 255 + " " + "a" * 257, ".", " , ."]
    want = [tiktoken.encode_ordinary(t or "") for t in texts]
    assert encoded(own, texts) == want
    assert encoded(own, texts[::-1]) == want[::-1]
    for t, ids in zip(texts, want):
        assert encoded(own, [t]) == [ids]
        assert bytes(own.decode(np.array(ids, "<u4"))[1]) == (t or "").encode()
    column = pa.array(["left out", *texts])[1:]
    assert byte_bpe._digests(own, column, *own.encode(column), list("abcd")).column(1).to_pylist() == list(map(len, want))
    assert encoded(own, []) == []
    with pytest.raises(KeyError):
        byte_bpe.Codec({**ranks, b"zqzqzq": 70_000}, pattern).decode(np.array([60_000]))


@pytest.mark.parametrize("seed", range(4))
def test_shared_queue_with_ranks_in_any_order(seed):
    """Merges may make pairs of lower rank than their own; spans of ranks and gaps between ranks do not matter."""
    draw = random.Random(seed)
    longer = list({bytes(draw.choices(b"abc", k=draw.randint(2, 6))) for _ in range(300)})
    numbers = draw.sample(range(256, 30_000), len(longer))
    ranks = {bytes([b]): b for b in range(256)} | dict(zip(longer, numbers))
    own = byte_bpe.Codec(ranks, byte_bpe.default_pattern())
    pieces = [bytes(draw.choices(b"abcd", k=draw.randint(1, 40))) for _ in range(3000)]
    sizes = np.array(list(map(len, pieces)))
    ids, counts = own.merge_all(np.frombuffer(b"".join(pieces), np.uint8), sizes)
    ends = np.cumsum(counts)
    for p, a, b in zip(pieces, ends - counts, ends):
        if p not in ranks:
            assert ids[a:b].tolist() == own.merge(p)


def test_other_patterns_skip_no_word():
    ranks, pattern = byte_bpe.load_ranks(byte_bpe.default_ranks()), r" ?\p{L}{1,2}| ?[^\s\p{L}]+|\s+"
    own, tiktoken = byte_bpe.Codec(ranks, pattern), library(ranks, pattern)
    for text in ("abc, def.", "abc"):
        assert encoded(own, [text]) == [tiktoken.encode_ordinary(text)]


class Counting:
    """The library, counting the words that it is given."""

    def __init__(self, library):
        self.library, self.words = library, 0

    def encode_batch_fast(self, texts, **options):
        self.words += sum(len(t.split(" ")) for t in texts)
        return self.library.encode_batch_fast(texts, **options)


def test_token_store_gives_a_word_to_the_library_once():
    """Case and marks make no new words, and those of blocks before are remembered."""
    from tokenizers import Tokenizer

    own, whole = token_store.Encoder(token_store.default_tokenizer()), Tokenizer.from_file(token_store.default_tokenizer())
    own.tokenizer = counting = Counting(own.tokenizer)
    made = sorted({w.lower() for w in words(5000, 2) if "ß" not in w})  # which is SS in upper case
    texts = [" ".join(f(w) + m for w in made) for f in (str.lower, str.upper, str.title) for m in ("", ",", ".", "!?", '"...', "###", "'")]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert counting.words <= len(made) + 10
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    own.encode(["the"])
    own.encode([" ".join(made[::-1])])
    assert counting.words <= len(made) + 10


def test_token_store_encodes_any_mix_of_texts(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "REMEMBERED", 40)
    monkeypatch.setattr(token_store, "REMEMBERED_WORDS", 60)
    monkeypatch.setattr(token_store, "JOINED", 7)
    own, whole = token_store.Encoder(token_store.default_tokenizer()), Tokenizer.from_file(token_store.default_tokenizer())
    texts = [f"{c}a{c.upper()}{c.lower()}{m} {c}{m}" for c in token_store.LATIN for m in ("", ".", "'s", "`", "^x", "́")]
    texts += [a + b for a in ("İ", "x", "ß", "I") for b in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
    texts += ["", " ", "\n\n", "a  b", "Привет, мир. МИР", "x<|endoftext|> y<|endoftext|>.", "<|startoftext|>a", "日本語。 1234, a1", "we'll don't 's '", "a\tb c.", "é. É", "A" * 3000, "\x00. x\x00"]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
        for i in range(0, len(texts), 50):
            assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts[i : i + 50])] == want[i : i + 50]
            assert len(own.words) == len(own.word_ids) <= 60 and len(set(own.words.to_pylist())) == len(own.words)
    ids, starts = own.encode_column(pa.array(["left out", None, "a b"])[1:])
    assert starts.tolist() == [0, 0, 2] and ids.tolist() == whole.encode("a b", add_special_tokens=False).ids
