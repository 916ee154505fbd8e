"""Plain single-process versions of operators, to compare with."""

from __future__ import annotations

from collections import defaultdict


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def shingle_set(text: str | None, size: int = 5) -> set:
    w = [x.lower() for x in words(text)]
    if not w:
        return set()
    if len(w) < size:
        return {tuple(w)}
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near_duplicates(rows: list[tuple]) -> dict:
    """doc_id -> (n_shingles, component_id), by counting common shingles of all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    where, parent = defaultdict(list), {i: i for i in sets}
    for i in sorted(sets):
        for s in sets[i]:
            where[s].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in where[s]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def byte_bpe(text: str | None) -> tuple[int, str, str]:
    """n_tokens, SHA-256 of ids and of the text, by the reference library."""
    import base64
    import hashlib

    import numpy as np
    import public_tokenizers as P
    import tiktoken

    if "multi" not in _ENCODINGS:
        with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS["multi"] = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = _ENCODINGS["multi"].encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


_ENCODINGS: dict = {}


def token_rows(rows: list[tuple]) -> list[tuple]:
    """doc_id, start, n_tokens, crc32 in order of ids, whole texts through the library."""
    import zlib

    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def suffix_dedup(rows: list[tuple], length: int = 50) -> dict:
    """doc_id -> (n_bytes, n_removed, n_spans, SHA-256 of the rest), by a set of all strings."""
    import hashlib

    first: dict[bytes, int] = {}
    data = sorted((i, (t or "").encode()) for i, t in rows)
    for i, t in data:
        for s in range(len(t) - length + 1):
            first.setdefault(t[s : s + length], i)
    out = {}
    for i, t in data:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < i:
                gone[s : s + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
