"""Encoding, decoding, counts by section and packing, against the tokenizers library and brute force."""

from __future__ import annotations

import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelloom.llm import bpe, packing, token_counts
from labelloom.llm.tokens import encoder

PATH = bpe.vocabulary_path()
LONG = "Überlange Wörter 漢字 😀 don't  stop\n\n  1²3 " * 3000
ODD = [
    "", " ", "  \n \x1c x", "naïve café 　b", "<|endoftext|> a<|endoftext|><|endoftext|>", "x" * 5000, "'s'T 'll", "a_b__c 9Ⅷ", LONG,
]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def rows(spark):
    """Null, empty, odd, long and repeated texts, a null id, and other columns with clashing names."""
    data = [(i, t, 1, "k") for i, t in enumerate(ODD)] + [(90, None, 2, None), (None, "no id", 3, "k"), (1, " ", 1, "k")]
    return spark.createDataFrame(data, "doc_id long, text string, ids int, piece string")


def ids_of(reference, text):
    return reference.encode(text or "", add_special_tokens=False).ids


def test_both_encoders_give_the_library_s_ids(reference):
    rng = random.Random(3)
    alphabet = "  \n\t\x1c\x85 'stdmre a_1²Ⅷé漢😀,.　"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    expected = [e.ids for e in reference.encode_batch_fast(texts, add_special_tokens=False)]
    coder = bpe.Codec(PATH)
    found = coder.encode_batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == expected
    assert [coder.decode(x) for x in found] == [reference.decode(e, skip_special_tokens=False) for e in expected]
    assert [encoder(PATH).ids(t).tolist() for t in texts] == expected


def test_every_character_is_cut_as_the_library_does(reference):
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}1 \n {chr(c)} " for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    expected = [e.ids for e in reference.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Codec(PATH).encode_batch(texts)] == expected


def test_broken_bytes_decode_as_in_the_library(reference):
    ids = ids_of(reference, "漢")[:1] + ids_of(reference, "é😀")[:-1]
    assert bpe.Codec(PATH).decode(bpe.pack(ids)) == reference.decode(ids, skip_special_tokens=False)


def test_a_small_memory_gives_the_same_ids(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 3)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 3)
    coder = bpe.Codec(PATH)
    texts = ["one two three four five", "six seven one"]
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in coder.encode_batch([t])] == [ids_of(reference, t) for t in texts]


def test_encode_and_decode_tables(rows, reference):
    found = bpe.decode(bpe.encode(rows, PATH), PATH).collect()
    assert sorted((r.text for r in found)) == sorted((r.text or "") for r in rows.collect())
    assert all(np.frombuffer(r.ids, "<u4").tolist() == ids_of(reference, r.text) for r in found)
    assert bpe.decode(bpe.encode(rows.limit(0), PATH), PATH).count() == 0


def test_counts_by_line(rows, reference):
    found = token_counts.counted(rows, token_counts.lines(rows["text"]), PATH, "first").collect()
    by = {(r.doc_id, r.section): r for r in found}
    for i, text in enumerate(ODD):
        line_of, n, expected = [], 0, {}
        for char in text:
            line_of.append(None if char == "\n" else n)
            n += char == "\n"
        for start, end in reference.encode(text, add_special_tokens=False).offsets:
            line = next((k for k in line_of[start:end] if k is not None), -1)
            expected[line] = expected.get(line, 0) + 1
        at = 0
        for k, line in enumerate(text.split("\n")):
            row = by[i, k]
            assert (row.start, row.end, row.n_tokens) == (at, at + len(line), expected.get(k, 0))
            at += len(line) + 1
        assert (by[i, -1].n_tokens if (i, -1) in by else 0) == expected.get(-1, 0)
    totals = {}
    for r in found:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.n_tokens
    assert all(totals[i] == len(ids_of(reference, t)) for i, t in enumerate(ODD) if i != 1)
    assert token_counts.counted(rows.limit(0), token_counts.lines(rows["text"]), PATH).count() == 0


def test_rules_for_boundaries():
    starts, stops = np.array([0, 2, 6, 9]), np.array([2, 6, 9, 11])
    sections = np.array([[0, 3], [3, 7], [10, 11]])
    assert token_counts.allocate(starts, stops, sections, "first").tolist() == [2, 1, 1, 0]
    assert token_counts.allocate(starts, stops, sections, "last").tolist() == [1, 2, 1, 0]
    assert token_counts.allocate(starts, stops, sections, "most").tolist() == [1, 2, 1, 0]
    assert token_counts.allocate(starts, stops, np.empty((0, 2), int), "most").tolist() == [4]
    tie = token_counts.allocate(np.array([2]), np.array([4]), np.array([[0, 3], [3, 9]]), "most")
    assert tie.tolist() == [1, 0, 0]


def test_overlapping_sections_are_refused(spark):
    rows = spark.sql("select 1 doc_id, 'abc def' text, array(struct(0 start, 3 end), struct(2 start, 5 end)) s")
    with pytest.raises(Exception, match="overlap"):
        token_counts.counted(rows, rows["s"], PATH).collect()


def test_pieces(rows, reference):
    found = packing.pieces(rows, PATH, capacity=64).collect()
    for i, text in enumerate(ODD):
        ids = np.array([*ids_of(reference, text), 0], "<u4")
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.piece)
        own = own[:1] if i == 1 else own
        assert sum(r.length for r in own) == len(ids) and all(r.length == 64 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)


def fewest(items, capacity):
    """Fewest bins by exhaustive search."""

    @lru_cache(None)
    def search(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = 99

        def fill(room, start, used, others):
            nonlocal best
            best = min(best, 1 + search(tuple(others[i] for i in range(len(others)) if i not in used)))
            for i in range(start, len(others)):
                if i not in used and others[i] <= room:
                    fill(room - others[i], i + 1, used | {i}, others)

        fill(capacity - first, 0, frozenset(), rest)
        return best

    return search(tuple(sorted(items, reverse=True)))


def test_fixed_sets_cost_nothing():
    rng = random.Random(5)
    for _ in range(150):
        items = [rng.randint(1, 12) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(items, minlength=13)
        fixed, rest = packing.reduced(counts, 12)
        left = [length for length in range(13) for _ in range(rest[length])]
        assert all(sum(lengths) <= 12 for lengths, _ in fixed)
        assert sum(n for _, n in fixed) + fewest(left, 12) == fewest(items, 12)


def test_plan_places_every_item_once():
    rng = np.random.default_rng(0)
    for scale in (1, 1000):
        counts = np.bincount(rng.integers(1, 101, 500), minlength=101) * scale
        filled, taken = {}, np.zeros(101, int)
        for run in packing.plan(counts, 100):
            assert run.first == taken[run.length] and run.n > 0
            taken[run.length] += run.n
            if scale == 1:
                for i in range(run.n):
                    filled.setdefault(run.sequence + i // run.each, []).append((run.offset + i % run.each * run.length, run.length))
        assert (taken == counts).all()
        for places in filled.values():
            places.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0
            assert sum(n for _, n in places) <= 100


def test_pack_with_one_length_in_most_rows(spark):
    rows = spark.range(5000).selectExpr("id as k", "if(id % 10 < 7, 30, 1 + id % 97) as length", "'x' as sequence_id")
    found = packing.pack(rows, ["k"], capacity=100).toPandas()
    assert len(found) == 5000 and found.groupby("sequence_id")["length"].sum().max() <= 100
    for _, part in found.sort_values("offset").groupby("sequence_id"):
        assert (part["offset"].to_numpy() == np.cumsum(part["length"]) - part["length"]).all()
    assert found["sequence_id"].nunique() <= -(-found["length"].sum() // 100) * 1.08  # half of the room beside three of length 30 has nothing to fill it
    assert packing.pack(rows.limit(0), ["k"]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(rows.selectExpr("k", "cast(null as int) length"), ["k"])


def test_lines_of_a_very_long_text(spark):
    """A million lines in a few seconds, by the sections of a column and by those the task finds itself."""
    text = "ab\n" * 1_000_000 + "é😀"
    spans = token_counts.line_spans(text)
    assert len(spans) == 1_000_001 and spans[1].tolist() == [3, 5] and spans[-1].tolist() == [3_000_000, 3_000_002]
    rows = spark.createDataFrame([(1, "a b\n\nc\n"), (2, ""), (3, None), (4, text)], "doc_id long, text string")
    found = token_counts.counted(rows, None, PATH).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    counts = {r.doc_id: (r.n, r.t) for r in found.collect()}
    assert counts[4][0] in (1_000_001, 1_000_002) and counts[2] == counts[3] == (1, 0)
    few = rows.filter("doc_id < 4")
    by_column = token_counts.counted(few, token_counts.lines(F.coalesce("text", F.lit(""))), PATH).collect()
    assert sorted(by_column) == sorted(token_counts.counted(few, None, PATH).collect())


def test_packed_rows_keep_columns_of_any_name(spark):
    rows = spark.range(50).selectExpr("id", "'mine' AS _row", "'own' AS _chunk", "id AS _rank", "1 AS _base", "int(id % 7 + 1) AS _length")
    found = packing.pack(rows, ["id"], length="_length", capacity=20)
    assert found.columns == [*rows.columns, "sequence_id", "offset"]
    assert sorted(tuple(r)[:6] for r in found.collect()) == sorted(map(tuple, rows.collect()))
