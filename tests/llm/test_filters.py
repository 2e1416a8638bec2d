"""Quality rules, toxicity, secrets, licences and archives."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import string
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import licenses, quality, secret_scans, toxicity, warc
from labelloom.staging import new_path, stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_text_counts():
    text = "a b c a b c d\n\n x#y \n x#y \nx#y\v*|"
    assert quality.text_counts(text) == (11, 18, 5, 1, 6, 4)
    assert quality.text_counts("a a a a") == (4, 4, 0, 0, 4, 1)
    assert quality.text_counts("") == quality.text_counts(" \n\t") == (0,) * 6
    rng = random.Random(0)
    for _ in range(200):
        text = " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        found, n = text.split(), len(text.split())
        windows = [tuple(found[i : i + 3]) for i in range(n - 2)]
        covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        assert quality.text_counts(text)[4] == len(covered)


def test_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(60, 200)), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(300)]
    rows += [(1000 + i, words(rng, 80).replace(" ", " | "), "en", "hot", 1) for i in range(9)]
    rows += [(2000 + i, rows[0][1], "en", "hot", 1) for i in range(100)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "hot", 0), (3002, "a " * 30_000, "en", "hot", 0), (3003, words(rng, 70), None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_quality", F.lit(1)).withColumn("_c", F.lit("x"))
    found = {r.doc_id: r for r in quality.judged(df).collect()}
    assert len(found) == len(rows) and {i for i, r in found.items() if not r._quality.kept} == {*range(1000, 1009), 3000, 3001, 3002}
    assert found[3002]._quality.base_failed and not found[1000]._quality.base_failed and found[1]._c == "x"
    assert quality.judged(df.limit(0)).count() == 0


def test_sketches_merge_exactly(spark):
    values = spark.range(5000).select((F.col("id") * F.col("id") % 9973).alias("v"))
    buckets = [tuple(r) for r in values.select("v", quality.bucket_of(F.col("v")).alias("b")).collect()]
    assert all(b <= v < b + max(1, b / 63) for v, b in buckets)
    measured = values.select(
        F.when(F.col("v") % 2 == 0, "a").otherwise("b").alias("g"),
        F.struct(F.lit(1).alias("n_words")).alias("_c"),
        F.struct(*[F.col("v").alias(s) for s in quality.SLACK]).alias("_s"),
    )
    parts = quality.merged(quality.sketches(measured, ("g",)), ())
    whole = quality.sketches(measured.withColumn("all", F.lit(0)), ("all",)).drop("all")
    assert sorted(parts.collect()) == sorted(whole.collect())


def toxic_rows(rng, start, n):
    bad = ["grumbfool", "grumbfools", "nastyword", "vilething", "scumlike"]
    for i in range(start, start + n):
        text = words(rng, rng.randint(20, 80)).split()
        toxic = rng.random() < 0.3
        for _ in range(3 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        yield i, " ".join(text), int(toxic), int(rng.random() < 0.8)


def test_the_sample_is_bounded_by_its_entries(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_ENTRIES", 2000)
    rows = list(toxic_rows(random.Random(2), 0, 600))
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, t, q in rows], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r._toxicity.toxic for r in toxicity.scored(docs, labels).collect()}
    assert sum(found[i] != bool(t) for i, _, t, _ in rows) <= 30


def test_the_chain_finds_held_out_toxic_texts(spark):
    rows = list(toxic_rows(random.Random(2), 0, 900))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (3, rows[3][1], "x")], "doc_id long, text string, _p_toxic string")
    labels = [(i, q, t) for i, _, t, q in rows if i < 600] + [(None, 1, 1), (7, None, 1), (99999, 1, 1), (5, 1, rows[5][2])]
    found = toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(found) == 903 and all(r._p_toxic == "x" for r in found)
    by = {r.doc_id: r._toxicity for r in found}
    wrong = [i for i, _, t, _ in rows if i >= 600 and by[i].toxic != bool(t)]
    assert len(wrong) <= 3 and not by[5000].toxic and by[5000].p_toxic == by[5001].p_toxic
    assert all(0 <= by[i].p_toxic_prose <= 1 for i in range(900))


def test_features_of_a_large_group_of_copies_stay_one_row_for_each_text(spark, monkeypatch):
    """The features come from the list of tokens in place, not from a row for each token that is joined and gathered again."""
    copied = " ".join(f"word{i}" for i in range(300))
    rows = [(i, copied if i % 4 else f"text{i % 40} other{i % 8}", int(i % 3 == 0)) for i in range(400)] + [(400, "", 0)]
    staged = {}
    monkeypatch.setattr(toxicity, "stage", lambda df, name: staged.setdefault(name, stage(staged.setdefault(name + "-plan", df), name)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxicity.train(docs.drop("toxic"), docs.select("doc_id", F.lit(1).alias("quality"), "toxic"))
    plan = staged["features-plan"]._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Join|Generate|Exchange", plan)
    found = {r["_id"]: r["f"] for r in staged["features"].collect()}
    words = {r["_id"]: r["tokens"] for r in staged["training"].collect()}
    known = {t for r in staged["token-counts"].collect() for t in [r["t"]]}
    assert len(found) == 401 and found[400] == []
    assert len(found[1]) == len(known.intersection(words[1])) >= 300 and found[1] == found[2]
    assert 0 < len(found[0]) == len(known.intersection(words[0])) and not set(found[0]) & set(found[1])
    assert chain.probabilities(copied)


def test_the_deciding_link_is_fed_by_the_others():
    """Neither word of the first links tells the last category on its own features: it takes the earlier probabilities."""
    rng = np.random.default_rng(3)
    first = rng.random(600) < 0.5
    second = rng.random(600) < 0.5
    features = np.concatenate([[0] * a + [1] * b for a, b in zip(first.tolist(), second.tolist())]).astype(np.int32)
    rows = toxicity.Rows(features, first.astype(int) + second, 3)
    targets = np.column_stack([first, second, first | second]).astype(float)
    nothing = np.array([2], np.int32)
    keys = [None, 0, 1, 2]
    chosen = {(i, k): np.array([i], np.int32) if i < 2 else nothing for i in range(3) for k in keys}
    models, limit = toxicity.fit_chain(rows, targets, np.arange(600) % 3, chosen)
    chain = toxicity.Chain(models, ["aaa", "bbb", "ccc"], limit)
    assert all(w > 0 for w in models[2].before)
    for text, want in (("aaa", True), ("bbb", True), ("aaa bbb", True), ("ccc", False), ("", False)):
        assert (chain.probabilities(text)[2] >= limit) == want


def test_the_chain_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    for labels in ([], [(1, 1, 0)]):
        found = toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert found[0]._toxicity.toxic is False and found[0]._toxicity.p_toxic is None
    assert toxicity.scored(docs.limit(0), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).count() == 0


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def bits(window):
    return round(sum(secret_scans._scaled(window.count(c)) for c in set(window)))


def mixed_spans(text, base):
    for m in re.finditer(secret_scans.CANDIDATE, text):
        if any(re.search(p, m[0]) for p in secret_scans.ALLOWED):
            continue
        n = secret_scans.WINDOW
        windows = [m[0][i : i + n] for i in range(len(m[0]) - n + 1)]
        hexadecimal = lambda w: set(w) <= set(string.hexdigits) and re.search("[0-9]", w) and re.search("[A-Fa-f]", w)
        limits = [3.0 if set(m[0]) <= set(string.hexdigits) or hexadecimal(w) else 3.7 for w in windows]
        hot = [i for i, (w, least) in enumerate(zip(windows, limits)) if bits(w) <= secret_scans.most_sum(least)]
        if hot:
            span = (m.start() + hot[0], 3, "entropy", m.start() + hot[-1] + n)
            if not any(b[0] <= span[0] and span[3] <= b[3] for b in base):
                yield span


def secret_texts(rng):
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(n))
    texts = [
        "token=secret=abcdefgh", "token = secret: abcdefghij", "éé PassWord\" :  'hunter2hunter2' x", "api_key=short APIKEY: longenough1",
        "AKIA" + "A" * 11, "AKIA" + "B7" * 8 + "x", "AKIAAKIAAKIAAKIA12", "😀" + "0a" * 16 + "g" + "f" * 31, "ſecret=abcdefghi toKen=abcdefghi",
        "aaaaaaaaaaaaaaaaaaaaaaaaa1", "abcdefghijklmnopqrstuvwxyz0123456789", "some_long_identifier_name_1234", "1234567890" * 4, "", None,
    ]
    texts += [f"see {key(rng.randint(20, 60))} and 漢{key(40)}, " + "x" * rng.randint(0, 50) + key(25) for _ in range(60)]
    texts += ["".join(rng.choice("token=:' AKI09afZ\"") for _ in range(200)) for _ in range(60)]
    hexadecimal = lambda n: "".join(rng.choice(string.hexdigits[:16]) for _ in range(n))
    texts += [f"{before}{hexadecimal(rng.randint(20, 31))} x" for before in ("key=", "v1/", "id-", "A_", "Zz9", "") for _ in range(8)]
    texts += [f"token={hexadecimal(40)}/{key(30)} {hexadecimal(24)}={hexadecimal(34)}" for _ in range(10)]
    return texts + ["a1" * 30_000 + key(50), ("word " * 20_000) + "secret='" + key(20) + "'"]


def test_secrets(spark):
    texts = secret_texts(random.Random(6))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1)], "doc_id long, text string, k string, _secrets int")
    found = secret_scans.scanned(df)
    assert found.columns == ["doc_id", "text", "k", "_secrets"]
    for r in found.collect():
        base = base_spans(r.text or "")
        assert [tuple(s) for s in r._secrets] == sorted([*base, *mixed_spans(r.text or "", base)]), r.text
    digests = {r.doc_id: r for r in secret_scans.digest(found).collect()}
    listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in base_spans(texts[2]))
    assert digests[2].base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and digests[2].n_assign == 1
    for r in secret_scans.masked(df).collect():
        out, at, text = "", 0, texts[r.doc_id]
        base = base_spans(text or "")
        spans = sorted((s[0], s[3]) for s in [*base, *mixed_spans(text or "", base)])
        for start, end in spans:
            if start >= at:
                out += text[at:start] + secret_scans.MARK
            at = max(at, end)
        assert r.text == (None if text is None else out + text[at:])
    assert secret_scans.scanned(df.limit(0)).count() == 0


def test_the_sql_finds_the_same_secrets(spark):
    rows = list(enumerate(secret_texts(random.Random(7))))
    found = secret_scans.digest(secret_scans.scanned(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        assert sorted(map(tuple, found)) == sorted(db.execute(secret_scans.oracle_sql()).fetchall())
    assert any("entropy" in r.spans for r in found)


def test_one_text_with_very_many_secrets(spark):
    """100,000 secrets of three kinds, in lines and in one line, in time that does not grow with their square."""
    rng = random.Random(8)
    hexadecimal = [f"{rng.getrandbits(144):036x}" for _ in range(50_000)]
    parts = [part for h in hexadecimal for part in (f"é {h}", f"token: v{h[:11]}Z{h[11:16]}")]
    texts = ["\n".join(parts), " ".join(parts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.monotonic()
    rows = {r.doc_id: r for r in secret_scans.digest(secret_scans.scanned(df)).collect()}
    masked = {r.doc_id: r.text for r in secret_scans.masked(df).collect()}
    assert time.monotonic() - start < 240  # 48 s with 8 threads; in quadratic time it would be some 20 minutes
    for i, text in enumerate(texts):
        base = base_spans(text)
        assert (rows[i].n_hex, rows[i].n_assign) == (50_000, 50_000)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in base).encode()).hexdigest()
        assert masked[i] == ("\n" if i == 0 else " ").join(["é " + secret_scans.MARK, secret_scans.MARK] * 50_000)


def test_masking_across_pieces(spark):
    rng = random.Random(9)
    n = secret_scans.PIECE
    texts = ["漢" * a + f" {rng.getrandbits(160):040x} " + "é😀" * b for a in (0, n - 42, n - 41, n - 20, n - 1, n, 3 * n - 1) for b in (0, 5, n)]
    found = {r.doc_id: r.text for r in secret_scans.masked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(texts))] == [re.sub("[0-9a-f]{40}", secret_scans.MARK, t) for t in texts]


def test_secrets_run_without_python(spark):
    plan = secret_scans.scanned(spark.sql("select 1L doc_id, 'x' text"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", text)


def entropy_spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r._secrets if s.kind == "entropy"] for r in secret_scans.scanned(df).collect()}
    return [found[i] for i in range(len(texts))]


def test_hexadecimal_keys_behind_other_characters(spark):
    rng = random.Random(16)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(20, 31))) for _ in range(200)]
    alone = entropy_spans(spark, keys)
    assert sum(map(bool, alone)) > 190
    for before in ("key=", "v1/", "id-", "A_"):
        for spans, moved in zip(alone, entropy_spans(spark, [before + k for k in keys])):
            for start, end in spans:
                assert any(a <= start + len(before) and end + len(before) <= b for a, b in moved)
    numbers = ["A_" + "".join(rng.choice("0123456789") for _ in range(24)) for _ in range(50)]
    assert not any(entropy_spans(spark, numbers))


def test_allowed_strings_of_any_length(spark):
    old, new = ((re.compile(p) for p in item) for item in secret_scans.ONE_WAY.items()).__next__()
    for n in range(8):
        for chars in itertools.product("1a_-A", repeat=n):
            assert bool(old.search("".join(chars))) == bool(new.search("".join(chars))), chars
    texts = ["chapter1" + "/section" * 12_500, "x1" + "-a" * 50_000, "_" * 100_000 + "A1", "1" * 100_000 + "/A_" * 10, "a1" + "_1" * 50_000]
    assert not any(entropy_spans(spark, texts))


NASTY = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" + "é😀" * 400


def test_archives(spark):
    long = "<p>" + "x" * 2_000_000
    rows = [(i, f"http://a/{i}\r\nX: y", h) for i, h in enumerate([NASTY, NASTY, "short", "short", None, "", long, long, NASTY + "\r\n\r\n", "y" * 1000, "y" * 1000, "z" * 999, "z" * 999])]
    rows += [(100 + i, None, "copy " * 300) for i in range(200)] + [(None, "http://n", "n" * 2000)]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, original int, digest string").repartition(4)
    path = new_path(spark, "warc-test")
    warc.write_archives(pages, path)
    read = warc.read_archives(spark, path)
    found = {r.page_id: r for r in warc.resolved(read).collect()}
    assert len(found) == len(rows)
    held = {r.page_id: bytes(r.payload).decode() for r in read.collect() if r.record_type == "response"}
    for page, _, html in rows:
        html = html or ""
        same = [p for p, _, h in rows if (h or "") == html and p is not None]
        r, data = found[page], html.encode()
        original = max(same) if len(data) >= 1000 and same and page != max(same) else None
        assert (r.payload_bytes, r.payload_digest, r.original) == (len(data), hashlib.sha1(data).hexdigest(), original)
        assert r.record_type == ("response" if original is None else "revisit") and (original is not None or held[page] == html)
    path = new_path(spark, "warc-test")
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_torn_archives_are_refused():
    record = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n".encode()
    assert [p for _, p in warc.parsed(iter([record[:10], record[10:], record]))] == [b"abc", b"abc"]
    for broken in (record[:-1], record[:20], b"junk\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parsed(iter([broken])))


def test_licences(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(words(rng, 30) for _ in range(4))) for i in range(400)]
    planted = {}
    for i, (family, notices) in enumerate(licenses.NOTICES.items()):
        planted[i * 7] = family
        rows[i * 7] = (i * 7, rows[i * 7][1] + "\n\n" + notices[0] + "\n" + words(rng, 12))
    rows += [(900, None), (901, ""), (902, "\n \n"), (903, words(rng, 20_000)), (0, rows[0][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, family string")
    scanner = licenses.train(df)
    found = [(r.doc_id, r.paragraph, r.family) for r in licenses.scanned(df, scanner).collect()]
    assert sorted(x for x in found if x[2] != "unknown") == sorted([*((i, 5, f) for i, f in planted.items()), (0, 5, planted[0])])
    assert sum(1 for x in found if x[2] == "unknown") <= 8
    other = spark.createDataFrame([(1, "This code is licensed under the Wombat Public License, version 3."), (2, "Plain words about a garden")], "doc_id long, text string")
    assert {r.doc_id: r.family for r in licenses.scanned(other, scanner).collect()}.get(1, "unknown") == "unknown"
    assert licenses.scanned(df.limit(0), scanner).count() == 0


def test_licences_inside_longer_lines(spark):
    rng = random.Random(18)
    rows = [(i, "\n".join(words(rng, 30) for _ in range(4))) for i in range(300)]
    planted = {}
    for family, notices in licenses.NOTICES.items():
        for notice in notices:
            for n in (30, 300, 3000):
                i = 1000 + len(planted)
                planted[i] = family
                rows.append((i, f"{words(rng, n // 2)} {notice} {words(rng, n // 2)}"))
    changed = licenses.NOTICES["MIT"][2].replace("free of charge", "gratis")
    rows += [(5000, words(rng, 200) + " " + changed), (5001, changed + " " + words(rng, 200)), (5001, changed + " " + words(rng, 200))]
    rows += [(6000, f"{words(rng, 40)} a copy of the {words(rng, 40)} with or without {words(rng, 40)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.paragraph, r.family) for r in licenses.scanned(df).collect()]
    expected = [*((i, 0, f) for i, f in planted.items()), (5000, 0, "MIT"), (5001, 0, "MIT"), (5001, 0, "MIT")]
    assert sorted(x for x in found if x[2] != "unknown") == sorted(expected)
    assert not [x for x in found if x[0] == 6000]


def test_words_and_probabilities_are_worked_out_once(spark):
    """No filter repeats the splitting of lines or the model; both cost most of a scan."""
    notice = licenses.NOTICES["MIT"][0]
    docs = spark.createDataFrame([(i, f"some other line {i} of text\n{notice}") for i in range(60)], "doc_id long, text string")
    found = licenses.scanned(docs, licenses.train(docs))
    plan = found._jdf.queryExecution().executedPlan().toString().split("+- BroadcastExchange")[0].splitlines()
    assert [line.count("UDF(") for line in plan if "UDF(" in line] == [4]  # hashing, margins, probabilities, their array
    assert sum(line.count("(lower(") for line in plan) == 1
    assert {(r.doc_id, r.paragraph, r.family) for r in found.collect()} == {(i, 1, "MIT") for i in range(60)}


def test_lines_with_words_and_stretches(spark):
    """Against plain Python: lines that hold a word, their number, and the runs around word triples of notices."""
    known = set(licenses._triples())
    cut = re.compile(r"[^\w.]+|[.](?!\d)")
    parts = ["", " ", ".", "...", "-- !", ".5", "v1.0", "\t\r", "Ä ö. Ü", "the of to", "Licensed under the MIT License.", "mit License file MIT license", "x", "٣", "Ⅷ", "½"]
    rng = random.Random(5)
    sentences = [n for v in licenses.NOTICES.values() for n in v]
    rows = [(i, "\n".join(rng.choice([*parts, " ".join([rng.choice(parts), *rng.choice(sentences).split()[: rng.randint(1, 9)], rng.choice(parts), *rng.choice(sentences).split()[-3:]])]) for _ in range(rng.randint(0, 9)))) for i in range(200)]
    docs = spark.createDataFrame([*rows, (200, None)], "doc_id long, text string")
    got = licenses.paragraphs(docs).withColumn("stretches", licenses.stretches(F.col("_words"))).collect()
    assert len(got) == licenses.count_paragraphs(docs) > 500
    want = {(i, k): w for i, text in rows for k, line in enumerate(text.split("\n")) if (w := [x for x in cut.split(line.lower()) if x])}
    assert {(r.doc_id, r.paragraph): r["_words"] for r in got} == want

    def runs(found):
        at, out = [i for i in range(len(found) - 2) if " ".join(found[i : i + 3]) in known], []
        for apart in licenses.APART:
            first = [a for j, a in enumerate(at) if j == 0 or a - at[j - 1] > apart]
            last = [a for j, a in enumerate(at) if j == len(at) - 1 or at[j + 1] - a > apart]
            out += [p for p in zip(first, last) if p not in out]
        return [found[a : b + 3] for a, b in out]

    assert all(r.stretches == runs(r["_words"]) for r in got) and sum(len(r.stretches) for r in got) > 100


def test_a_page_id_with_two_payloads_keeps_both(spark):
    a, b = "a" * 1000, "b" * 2000
    rows = [(7, "u", a), (7, "u", b), (9, "u", a), (11, "u", b), (11, "u", a + "c"), (None, "u", a), (7, "u", b)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.original) for r in warc.round_trip(spark, pages).collect())
    assert found == [
        (0, 1000, "response", None), (7, 1000, "revisit", 9), (7, 2000, "revisit", 11), (7, 2000, "revisit", 11),
        (9, 1000, "response", None), (11, 1001, "response", None), (11, 2000, "response", None),
    ]
