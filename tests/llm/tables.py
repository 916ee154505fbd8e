"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "an", "sor", "ble", "thé", "ru", "ßen"]
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def awkward() -> list[tuple]:
    base = prose(1, 120)
    near = base.replace(base.split()[60], "other", 1)
    long = "\n".join(prose(i, 40) for i in range(100, 180))
    texts = [base, near, base, None, "", "   \n\t", "two words", "two words", prose(2, 80), long, long + " end", "x" * 5000, "".join(c.upper() if c.isascii() else c for c in base), "\n".join(["same line of five words"] * 30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, base), (None, base), (None, None)]
    return [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
