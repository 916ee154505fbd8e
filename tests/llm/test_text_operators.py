import hashlib
import random

from pyspark.sql import functions as F

from framelens.llm import byte_bpe, decontam, line_templates, preference, quality, secret_scan, suffix_dedup, token_store
from tests.llm import brute, tables


def docs(spark, rows=None):
    return spark.createDataFrame(tables.awkward() if rows is None else rows, tables.DOCS)


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in ("kept", "n_words", "host", "n", "h", "line", "leaf", "chunk", "ids", "item_id")})


def test_quality_keeps_columns_and_rejects_short_texts(spark):
    df = clashing(docs(spark))
    kept = quality.kept_documents(df)
    assert kept.columns == df.columns
    texts = [r.text for r in kept.collect()]
    assert all(t and len(t.split()) >= 50 for t in texts)
    assert quality.kept_documents(docs(spark, [])).count() == 0


def test_hosts_are_shrunk_to_all_hosts(spark):
    good, bad = tables.prose(5, 90), "too short"
    rows = [(i, bad if i % 10 < 9 else good, "en", "bad", 1) for i in range(200)]
    rows += [(1000 + i, bad if i < 80 else good, "en", f"h{i % 40}", 1) for i in range(400)]  # one in five fails
    rows += [(5000, bad, "en", "one", 1), (5001, good, "en", "one", 1), (5002, bad, "en", "one", 1)]
    kept = {r.doc_id for r in quality.kept_documents(docs(spark, rows)).collect()}
    assert not kept & set(range(200))  # nine of ten fail: the host fails with its good documents
    assert {1000 + i for i in range(80, 400)} <= kept
    assert 5001 in kept  # two of three is no verdict on so small a host


def test_line_templates_drop_variable_lines(spark):
    rows = [(i, f"Copyright {1990 + i} Name{i} Corp all rights reserved\n{tables.prose(i, 20)}", "en", "s", 1) for i in range(12)]
    out = {r.doc_id: r._lines for r in line_templates.drop_recurring(clashing(docs(spark, rows))).collect()}
    assert out[0].n_dropped == 0 and all(out[i].n_dropped == 1 for i in range(1, 12))
    assert all(out[i].kept_text == tables.prose(i, 20) for i in range(1, 12))
    few = {r.doc_id: r._lines.n_dropped for r in line_templates.drop_recurring(docs(spark, rows[:4])).collect()}
    assert set(few.values()) == {0}


def test_line_templates_awkward_rows(spark):
    out = line_templates.drop_recurring(docs(spark)).select("doc_id", "text", "_lines.*").collect()
    assert len(out) == len(tables.awkward())
    assert all(r.kept_text == r.text for r in out if r.n_dropped == 0)
    assert line_templates.kept_documents(docs(spark, [])).count() == 0


def test_decontamination_catches_new_numbers_and_names(spark):
    item = "A train leaves the town of Marburg with 120 people and stops after 45 minutes at a lake where Karla pays 12 euros for a small red boat"
    other = item.replace("Marburg", "Weimar").replace("Karla", "Anton").replace("120", "300").replace("45", "20").replace("12 ", "7 ")
    mixed = "The train leaves but nobody in the town pays for a boat, and 12 people stop at the lake " + tables.prose(3, 60)
    rows = [(1, tables.prose(1, 50) + " " + item, "en", "s", 1), (2, tables.prose(2, 50) + " so " + other + " and on", "en", "s", 1), (3, mixed, "en", "s", 1),
            (4, None, "en", "s", 1), (5, "", "en", "s", 1), (None, item, "en", "s", 1)]
    items = spark.createDataFrame([(9, item), (10, "too short"), (11, None)], "item_id long, text string")
    df = clashing(docs(spark, rows))
    got = {(r.doc_id, tuple(r._items or ())) for r in decontam.contamination(df, items).collect()}
    assert got == {(1, (9,)), (2, (9,)), (3, ()), (4, ()), (5, ()), (None, (9,))}
    assert {r.doc_id for r in decontam.kept_documents(df, items).collect()} == {3, 4, 5}
    assert decontam.kept_documents(df, items.limit(0)).count() == 6


def test_decontamination_needs_consistent_slots(spark):
    item = "first 11 then 22 after that 11 again with 22 more and 11 left over for 22 of them in 11 boxes"
    loose = item
    for i, n in enumerate(["11", "22"] * 4):
        loose = loose.replace(n, str(500 + i), 1)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("11", "7").replace("22", "8"), "en", "s", 1), (2, loose, "en", "s", 1)]
    got = {r.doc_id: r._items for r in decontam.contamination(docs(spark, rows), items).collect()}
    assert got == {1: [1], 2: None}


def test_secret_places_and_entropy(spark):
    text = 'é api_key = "Zk3xQ9vLp0RtY7uWmN2b", id 123e4567-e89b-42d3-a456-426614174000, x=' + "0123456789abcdef" * 2 + " token:abc"
    rows = [(1, text, "en", "s", 1), (2, None, "en", "s", 1), (3, "", "en", "s", 1), (4, "incomprehensibilities" * 3, "en", "s", 1), (5, ("pass word " * 20000) + "secret=abcdef", "en", "s", 1)]
    got = {r.doc_id: r.s for r in secret_scan.scan(clashing(docs(spark, rows))).select("doc_id", secret_scan.listed(F.col("_spans")).alias("s")).collect()}
    at = lambda x: f"{text.index(x)}:{text.index(x) + len(x)}"
    assert f"assign:{text.index('api_key')}:{text.index('Zk3') + 20}" in got[1].split(",")
    assert f"hex:{at('0123456789abcdef' * 2)}" in got[1].split(",") and "entropy:" in got[1]
    assert f"entropy:{at('123e4567-e89b-42d3-a456-426614174000')}" not in got[1]
    assert got[2] == got[3] == got[4] == "" and got[5] == "assign:200000:200013"


def test_running_sums_cross_blocks(spark):
    values = list(range(1000))
    got = spark.createDataFrame([(values,), ([],), ([5],)], "v array<bigint>").select(secret_scan.running_sums(F.col("v")).alias("s")).collect()
    assert got[0].s == [sum(values[:i]) for i in range(1000)]
    assert got[1].s in ([], None) and got[2].s == [0]


def test_token_table_equals_library(spark):
    rows = {r[0]: r for r in tables.awkward() if r[0] is not None}
    df = clashing(docs(spark, list(rows.values()))).repartition(5)
    got = sorted(tuple(r) for r in token_store.checksums(token_store.stored_tokens(df)).collect())
    assert got == brute.token_rows([(r[0], r[1]) for r in rows.values()])
    assert token_store.stored_tokens(docs(spark, [])).count() == 0
    assert token_store.stored_tokens(docs(spark)).count() == len(tables.awkward())


def test_byte_bpe_equals_library(spark):
    texts = [r[1] for r in tables.awkward()] + ["a  b\n\n c \t\nd ", " \n x　 y", "\x1c 1\x1c2", "ab" * 30000, "don't  we'll   they're\n"]
    df = clashing(docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(byte_bpe.encode(df)).collect()}
    assert got == {i: brute.byte_bpe(t) for i, t in enumerate(texts)}
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(byte_bpe.encode(df)).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_suffix_dedup_equals_all_strings(spark, monkeypatch):
    rows = {r[0]: (r[0], r[1]) for r in tables.awkward() if r[0] is not None}
    for i in range(40):  # a passage in other surroundings, cut at other places
        rows[200 + i] = (200 + i, tables.prose(i, 12) + tables.prose(999, 40)[i : 300 - i] + tables.prose(50 + i, 9))
    rows[300] = (300, "ab" * 400)
    rows[301] = (301, "b" + "ab" * 200 + "\n" + "ab" * 100)
    want = brute.suffix_dedup(list(rows.values()))
    df = spark.createDataFrame([(*r, "kept") for r in rows.values()], "doc_id long, text string, kept string").repartition(6)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.drop_repeats(df).collect()}
    assert got == want
    assert suffix_dedup.drop_repeats(docs(spark, [])).count() == 0
    repeated = suffix_dedup.drop_repeats(docs(spark)).collect()
    assert len(repeated) == len(tables.awkward())
    assert [r.n_removed > 0 for r in repeated if r.id is None and r.n_bytes] == [True]


def test_preference_prefix_and_masks(spark):
    turn = lambda role, text: {"role": role, "text": text}
    a = [turn("user", "hi"), turn("assistant", "né"), turn("user", None)]
    rows = [(1, a, a[:2] + [turn("assistant", "x")]), (2, a, a), (3, a, []), (4, [], a), (5, a, a[:1])]
    kind = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame(rows, f"id long, chosen {kind}, rejected {kind}")
    got = {r.id: r._pair for r in preference.format_pairs(df).collect()}
    assert got[1].n_prompt_turns == 2 and got[1].prompt == "<|user|>\nhi\n<|assistant|>\nné\n"
    assert got[1].chosen == "<|user|>\n\n" and got[1].rejected == "<|assistant|>\nx\n"
    assert [tuple(s) for s in got[1].rejected_segments] == [(14, 0), (1, 1), (1, 0)]
    assert got[2].n_prompt_turns == 3 and got[2].chosen == got[2].rejected == ""
    assert got[3].n_prompt_turns == got[4].n_prompt_turns == 0 and got[3].prompt == "" and got[4].chosen == ""
    assert got[5].n_prompt_turns == 1 and got[5].rejected == ""


def test_preference_pairs_of_a_hot_opening(spark):
    rows = []
    for c in range(50):
        rows += [(c, 0, "user", "same question"), (c, 1, "assistant", f"answer {c}"), (c, 2, "user", "more"), (c, 3, "assistant", "end")]
    rows += [(None, 0, None, None), (None, 0, "user", "x"), (90, 0, "assistant", "alone")]
    out = preference.pairs_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.conv_id for r in out) == list(range(50))
    assert {r.chosen_id for r in out} == {0}


def test_decontamination_of_long_excerpts_and_short_items(spark):
    long, near = tables.prose(77, 500), tables.prose(78, 60)
    words = long.split()
    items = spark.createDataFrame([(1, long), (2, "zorblat quimber festoon wagglet prindle"), (3, "too short"), (None, tables.prose(79, 30))], "item_id long, text string")
    around = lambda seed, mid: f"{tables.prose(seed, 40)} {mid} {tables.prose(seed + 1, 40)}"
    rows = [around(10, " ".join(words[200:390])), around(20, " ".join(words[7:20])), around(30, " ".join(words[50:60])),
            around(40, "zorblat, quimber festoon wagglet prindle!"), around(50, "quimber festoon wagglet prindle"), near, "too short", tables.prose(79, 30)]
    found = {r.doc_id: r._items for r in decontam.contamination(docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(rows)]), items).collect()}
    assert found == {0: [1], 1: [1], 2: None, 3: [2], 4: None, 5: None, 6: None, 7: [None]}


def test_decontamination_reads_each_template_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(decontam.common, "stored", lambda df, f=decontam.common.stored: (made.append(df), f(df))[1])
    items = spark.createDataFrame([(1, tables.prose(5, 40))], "item_id long, text string")
    decontam.hits(docs(spark), items)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in made]
    over_documents = [p for p in plans if "LogicalRDD" in p and "regexp_replace" in p and "doc_id" in p]
    assert len(over_documents) <= 2  # all documents once, and those with hits


def test_byte_bpe_in_one_pass(spark):
    df = docs(spark)
    assert sorted(map(repr, byte_bpe.round_trip(df).collect())) == sorted(map(repr, byte_bpe.digests(byte_bpe.encode(df)).collect()))


def test_byte_bpe_of_white_space_and_marks():
    """Against the library, also with a rank for white space, which the given ranks do not have."""
    import tiktoken

    ranks, pattern = byte_bpe.load_ranks(byte_bpe.default_ranks()), byte_bpe.default_pattern()
    ranks = {**ranks, b"  ": max(ranks.values()) + 1, b"\t ": max(ranks.values()) + 2}
    own = byte_bpe.Codec(ranks, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["a\tb\tc   d", "a  b", "  a", "a  ", "a \n b", "word, word. Word! naïve, ßtraße. don't it's,", "x\u0300. \u0130. \u02bc,", " , . ", ",.", "ǅ, ɐ.", "\u00a0 a\u2003 b", "a" * 3000, "theaatat, " * 50]
    for text in texts:
        parts = own.parts(text)
        assert list(memoryview(b"".join(parts)).cast("I")) == library.encode_ordinary(text), repr(text)
        assert own.decoded(parts) == text.encode()


def test_token_store_cuts_words_as_the_tokenizer_does(spark):
    """Every letter before a full stop or comma, also those that normalization splits into a base and a mark."""
    import unicodedata

    import numpy as np
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(token_store.default_tokenizer()), token_store.Encoder(token_store.default_tokenizer())
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LM"]
    for mark in ".,":
        texts = [f"x{c}{mark}" for c in letters]
        found = [np.frombuffer(ids, "<u4").tolist() for ids in own.encode(texts)]
        assert found == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_store_layout_allows_selective_reads(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = [(i, f"{tables.prose(i, 60)}", "en", "s", 1) for i in range(3000)]
    path = str(tmp_path / "tokens")
    token_store.write_tokens(docs(spark, rows).coalesce(1), path)
    files = sorted((tmp_path / "tokens").glob("part-*.parquet"))
    seen, pages = 0, 0
    for name in files:
        meta = pq.ParquetFile(name).metadata
        columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
        tokens = next(v for k, v in columns.items() if k.startswith("tokens"))
        assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & set(tokens.encodings) and tokens.has_offset_index and tokens.has_column_index
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["part_start"].encodings
        seen += meta.num_rows
        pages += columns["doc_id"].has_column_index
    assert seen == 3000 and pages == len(files)
    scan = spark.read.parquet(path).where("doc_id = 1234").select("doc_id", "n_tokens")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,1234)" in plan and "tokens" not in plan.split("ReadSchema")[1].replace("n_tokens", "")
    assert scan.count() == 1


def test_line_templates_generalise_alike_at_every_size(spark):
    names, cities = ([f"{w}{a}{b}" for a in "aeiou" for b in "bcdfghjklmnpqrstvwxy"[:20]] for w in ("An", "Ber"))
    for n in (300, 3_000, 10_000):
        rnd = random.Random(n)
        rows = [(i, f"This post was written by {rnd.choice(names)} from {rnd.choice(cities)} for our readers\nown{i} words{i} here", "en", "s", 1) for i in range(n)]
        out = line_templates.drop_recurring(docs(spark, rows)).groupBy("_lines.n_dropped").count().collect()
        assert {r.n_dropped: r["count"] for r in out} == {0: 1, 1: n - 1}, n


def test_line_templates_drop_short_and_long_lines(spark):
    passage = tables.prose(900, 60)
    rows = [(i, f"Read more\n{tables.prose(i, 20)}" + (f"\n{passage}" if i in (3, 8) else ""), "en", "s", 1) for i in range(30)]
    rows += [(200 + i, f"{i}\n{i} / {i + 1}", "en", "s", 1) for i in range(12)]
    rows += [(100, "Once only", "en", "s", 1), (101, "Twice here", "en", "s", 1), (102, "Twice here", "en", "s", 1)]
    out = {r.doc_id: r._lines for r in line_templates.drop_recurring(docs(spark, rows)).collect()}
    assert out[0].n_dropped == 0 and out[1].n_dropped == 1 and out[1].kept_text == tables.prose(1, 20)
    assert out[3].n_dropped == 1 and passage in out[3].kept_text  # the first document keeps the passage
    assert out[8].n_dropped == 2 and out[8].kept_text == tables.prose(8, 20)
    assert out[100].n_dropped == out[101].n_dropped == out[102].n_dropped == 0  # short lines need five documents
    assert all(out[200 + i].n_dropped == 0 for i in range(12))  # nothing but numbers, all of them different


def test_sliding_entropy_equals_counting_each_window(spark):
    import math
    from collections import Counter

    rnd = random.Random(5)
    values = ["".join(rnd.choice(alphabet) for _ in range(n)) for alphabet in ("ab", "0123456789abcdef", "ABCdef0123+/_=-xyzXYZ") for n in (20, 21, 40, 133)]
    values += ["a" * 30, "".join(rnd.choice("abcdefgh") for _ in range(3000)), "é" * 25]
    found = spark.createDataFrame([(v,) for v in values], "v string").select("v", secret_scan.most_entropy(F.col("v")).alias("h")).collect()
    for r in found:
        own = max(-sum(n / 20 * math.log2(n / 20) for n in Counter(r.v[i : i + 20]).values()) for i in range(len(r.v) - 19))
        assert abs(r.h - own) < 1e-9


def test_one_very_long_candidate(spark):
    rnd = random.Random(6)
    long = "".join(rnd.choice("abcdefABCDEF0123456789") for _ in range(1_000_000))
    got = secret_scan.scan(docs(spark, [(1, f"x {long} y", "en", "s", 1)])).select("_spans").first()[0]
    assert [(s.start, s.end) for s in got if s.kind == 3] == [(2, 1_000_002)]
