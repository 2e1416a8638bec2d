"""Alignment of tokenizers, periodic runs and language-model scores, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelloom.llm import alignment, bpe, lookup, ngrams, queries, runs

BYTE_PATH, PIECE_PATH = bpe.vocabulary_path(alignment.BYTE_VOCABULARY), bpe.vocabulary_path(alignment.PIECE_VOCABULARY)
ODD = [
    None, "", " ", "  \n x ", "naïve café 漢字 😀", "<|endoftext|> a </s><s> <0x41>", "▁under▁", "x" * 5000, "a b " * 400,
    "Überlange Wörter don't  stop\n\n  1²3 " * 150, "one two three one two three one two three one two three", "ab\x00cd", " tail  ",
]


def table_of(spark, texts):
    """Repeated rows, a null id, and other columns with the names of inner ones."""
    data = [(i, t, 1, "k", 2.5) for i, t in enumerate(texts)] + [(None, "no id here", 2, None, 0.0), (4, texts[4], 1, "k", 2.5)]
    return spark.createDataFrame(data, "doc_id long, text string, _row int, block string, score double")


def random_texts(rng, n):
    words = ["the", "naïve", "tokens", "xqz", "漢字", "don't", "12345", "re", "  ", "\n", "Ünder", "unbelievable", "https://a.b/c?d=e"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(n)]


# --- alignment -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    first = Tokenizer.from_file(BYTE_PATH)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PIECE_PATH)


def spans(tokenizers, text):
    """Both sequences as (id, from, to) in bytes, by the libraries alone; empty where the contract says so."""
    first, second = tokenizers
    if not text:
        return [], []
    symbols = bpe.byte_symbols()
    spelled_a = [(i, bytes(symbols[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    spelled_b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        spelled_b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if any(b"".join(x for _, x in part) != whole for part in (spelled_a, spelled_b)):
        return [], []
    out = []
    for part in (spelled_a, spelled_b):
        at, row = 0, []
        for i, x in part:
            row.append((i, at, at + len(x)))
            at += len(x)
        out.append(row)
    return out


def brute_alignment(tokenizers, texts):
    found, held = [], Counter()
    for text in texts:
        a, b = spans(tokenizers, text)
        ends = sorted({t for _, _, t in a} & {t for _, _, t in b})
        groups = []
        for low, high in zip([0, *ends], ends):
            groups.append("|".join(",".join(str(i) for i, s, t in part if low <= s and t <= high) for part in (a, b)))
        links = [(x, y) for x, s, t in a for y, u, v in b if s < v and u < t] if len(a) < 800 else walked(a, b)
        held.update(set(links))
        found.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for n_a, n_b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((n_a, n_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest))
    return out


def walked(a, b):
    out, j = [], 0
    for x, s, t in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < t:
            out.append((x, b[k][0]))
            k += 1
    return out


@pytest.mark.parametrize("head", [lookup.HEAD, 5])
def test_alignment(spark, tokenizers, head, monkeypatch):
    texts = ODD + random_texts(random.Random(5), 40)
    df = table_of(spark, texts)
    monkeypatch.setattr(lookup.head_of, "__defaults__", (head,))
    monkeypatch.setattr(alignment, "SLICE_LINKS", 1000)
    got = sorted(((r.doc_id is None, r.doc_id), *r[1:]) for r in alignment.linked(df, BYTE_PATH, PIECE_PATH).collect())
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted(((d is None, d), *e) for (d, _), e in zip(rows, brute_alignment(tokenizers, [t for _, t in rows])))
    assert got == want
    assert {r[1] for r in got if r[0][1] in (0, 1, 6)} == {0}  # null, empty, and a text with the sign for a space


def test_groups_cover_both_sequences(spark):
    rng = random.Random(2)
    for _ in range(500):
        ends = [sorted({rng.randrange(1, 60) for _ in range(rng.randint(0, 40))} | {60}) for _ in range(2)]
        at = [0, 0]
        cut = []
        for one, i, to_i, j, to_j in alignment.stretches(*ends):
            assert [i, j] == at and ends[0][to_i - 1] == ends[1][to_j - 1]
            at = [to_i, to_j]
            cut.extend(ends[0][i:to_i] if one else [ends[0][to_i - 1]])
        assert at == [len(e) for e in ends] and cut == sorted(set(ends[0]) & set(ends[1]))
    df = spark.createDataFrame([(1, "Some unbelievable words"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.aligned(df, BYTE_PATH, PIECE_PATH).collect()}
    assert rows[2].groups == [] and rows[1].groups[-1].a_to == len(rows[1].a_ids) and rows[1].groups[-1].b_to == len(rows[1].b_ids)
    assert alignment.linked(df.limit(0), BYTE_PATH, PIECE_PATH).count() == 0


# --- runs ------------------------------------------------------------------------------------


def brute_runs(words):
    out = []
    for q in range(1, len(words) // runs.LEAST_PERIODS + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(runs.LEAST_WORDS, runs.LEAST_PERIODS * q):
                stretch = words[i : i + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        texts = []
        for _ in range(rng.randint(0, 5)):
            words = [b"%d" % rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
            if words and rng.random() < 0.6:
                a = rng.randrange(len(words))
                words[a : a + 5] = words[a : a + rng.randint(1, 6)] * rng.randint(2, 9)
            texts.append(words)
        assert runs.runs_of(texts) == [brute_runs(words) for words in texts]


def test_long_runs_take_linear_time():
    assert runs.runs_of([[b"a"] * 500_000, [b"x", b"y", b"z"] * 100_000]) == [[(0, 500_000, 1)], [(0, 300_000, 3)]]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 300_000:
        a, b = b, b + a
    assert runs.runs_of([b]) == [[]]  # squares and cubes everywhere, but nothing four times


def brute_digest(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-math.lcm(*range(1, 60)) * r[1] // r[2], r[0], r[2])) if found else None
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    said = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    shas = hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *shas)


def test_run_digest(spark, monkeypatch):
    rng = random.Random(9)
    texts = [t for t in ODD if t is None or len(t) < 5001] + ["a a a b b a a a b b " * 5, "\x1c x \x0b\x0c y"] + random_texts(rng, 120)
    df = table_of(spark, texts)
    monkeypatch.setattr(runs, "SLICE", 500)
    got = [tuple(r) for r in runs.digest(runs.scanned(runs.planted(df))).collect()]
    assert Counter(got) == Counter((r.doc_id, *brute_digest(r.doc_id, r.text)) for r in df.collect())
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 5
    found = {r.doc_id: r for r in runs.scanned(df).collect()}
    assert found[0].n_words == 0 and found[0].collapsed == "" and found[9].collapsed == "one two three"
    assert runs.digest(runs.scanned(df.limit(0))).count() == 0


# --- language model --------------------------------------------------------------------------


def training(rows):
    count, pairs = Counter(), Counter()
    n = 0
    for doc_id, text in rows:
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1:
            continue
        n += 1
        tokens = [*(text or "").encode().lower().split(), b" end"]
        count.update(tokens)
        pairs.update(zip([b" start", *tokens], tokens))
    return count, pairs, n


def test_scores(spark, monkeypatch):
    rng = random.Random(4)
    texts = ODD + [" ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = table_of(spark, texts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    count, pairs, n_texts = training(rows)
    total, distinct = sum(count.values()), len(count)
    model = ngrams.Model(df.filter(~ngrams.held_out(df["doc_id"])))
    got = ngrams.scored(df, model).collect()
    own = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    whole = total + 0.5 * (distinct + 1)
    middle = ngrams.counts_by_level()

    def said(n):
        return middle[ngrams.levels_of(np.array([n]))[0]] if n else 0.0

    exact = 0.0
    for doc_id, text in rows:
        tokens = [*(text or "").encode().lower().split(), b" end"]
        r = own[doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(t in count for t in tokens), total)
        assert r.held_out == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 0.5) / whole) for t in tokens))
        # the model with exact levels: some n-grams have been found once too often
        score = 0.0
        for first, second in zip([b" start", *tokens], tokens):
            before = n_texts if first == b" start" else said(count[first])
            share = (said(count[second]) + 0.5) / whole
            score += math.log10((min(said(pairs[first, second]), before) + ngrams.PRIOR * share) / (before + ngrams.PRIOR))
        exact += score
    assert sum(own[doc_id].score for doc_id, _ in rows) == pytest.approx(exact, rel=0.03)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # the same by shards that are not sent, in many small blocks, and with few words sent to every task
    monkeypatch.setattr(ngrams, "BLOCK", 3000)
    monkeypatch.setattr(lookup.head_of, "__defaults__", (5,))
    other = ngrams.scored(df, model, most_sent=0).collect()
    key = lambda r: (r.doc_id is None, r.doc_id)
    for x, y in zip(sorted(got, key=key), sorted(other, key=key), strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:])


def test_filter_counts_are_never_too_small():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    counts = rng.integers(1, 5000, 20_000)
    bits, _ = ngrams.built(keys, counts)
    held = ngrams.Filter(2, iter([(0, bits)]), len(bits))
    want = ngrams.levels_of(counts)
    got = held.levels(keys)
    assert (got >= want).all() and (got == want).mean() > 0.95
    unseen = held.levels(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    assert (unseen > 0).mean() < 1.5 * 2.0**-ngrams.PROBES


def test_scores_without_training(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = ngrams.scored(df, ngrams.Model(df.limit(0))).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)}
    assert ngrams.scored(df.limit(0), ngrams.Model(df)).count() == 0


def test_new_queries_give_a_row_per_document(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for query in (queries.op11_tokenizer_alignment, queries.op12_periodic_runs, queries.op13_lm_scores):
        rows = query(spark, sf)
        assert rows.select(F.count("*"), F.countDistinct("doc_id")).first()[:] == (n, n)
