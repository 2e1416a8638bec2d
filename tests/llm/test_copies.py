"""Fingerprints and near-duplicates against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from labelloom.llm import components as components_module
from labelloom.llm import fingerprints, neardup
from labelloom.llm.components import components


def shingles(text, width):
    found = (text or "").encode().lower().split()
    width = min(width, len(found))
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)} if found else set()


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


def edited(rng, text, share):
    found = text.split()
    for _ in range(max(1, int(share * len(found)))):
        found[rng.randrange(len(found))] = f"e{rng.randint(0, 10**6)}"
    return " ".join(found)


def sample(rng):
    """Random texts, a large group of near copies about the threshold, texts that share a passage, copies, odd ones."""
    base, passage = words(rng, 200), words(rng, 120)
    texts = [words(rng, rng.randint(3, 120)) for _ in range(60)]
    texts += [edited(rng, base, rng.choice([0.005, 0.02, 0.04, 0.06])) for _ in range(150)]
    texts += [passage + " " + words(rng, 60) for _ in range(60)]
    texts += [base] * 30 + ["Same Words here", "same\twords HERE"] + [None, "", " \n", "one", "ONE", "one two", " "]
    texts += [words(rng, 20_000)]
    return list(enumerate(texts))


def exact(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    low = {}
    for i, found in sets.items():
        if found:
            low.setdefault(frozenset(found), i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    reps = list(low.items())
    for n, (a, i) in enumerate(reps):
        for b, j in reps[n + 1 :]:
            common = len(a & b)
            if 100 * common >= percent * (len(a) + len(b) - common):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(low[frozenset(s)]) if s else i) for i, s in sets.items()}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (201, 200), (200, 201), (200, 201)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_near_duplicates_are_those_of_all_pairs(spark):
    rows = sample(random.Random(1))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, key string")
    for width, percent in ((3, 85), (5, 80)):
        found = neardup.near_duplicates(df, width, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == exact(rows, width, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id long, text string"
    same = "a b c d e f g"
    df = spark.createDataFrame([(5, same), (5, "other words for this id here"), (3, same), (3, same), (None, same), (None, "alone it is")], schema)
    found = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(df).collect())
    assert found == [(-1, -1, True), (-1, 3, False), (3, 3, True), (3, 3, True), (5, 3, False), (5, 5, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def expected_fingerprints(rows):
    ordered = sorted(rows, key=lambda r: -r[0])
    for i, (doc_id, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1] or ""
        text = text or ""
        cut = len(text) // 3
        yield doc_id, text, text[: len(text) - cut] + following[:cut], following


def test_fingerprints(spark):
    rows = [(3 * i + 1, t) for i, t in sample(random.Random(2))]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fingerprint int").repartition(5)
    found = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    assert len(found) == len(rows)
    off = []
    for doc_id, text, changed, following in expected_fingerprints(rows):
        r = found[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == fingerprints.written(fingerprints.sketch(text))
        assert r.edited_fingerprint == fingerprints.written(fingerprints.sketch(changed))
        a, b, c = (shingles(t, 5) for t in (text, changed, following))
        if len(a) > 50:
            off.append(abs(r.near_edited - len(a & b) / min(len(a), len(b))))
        if c and len(a) > 50 < len(c):
            off.append(abs(r.near_next - len(a & c) / min(len(a), len(c))))
        if text == following:
            assert r.near_next == 1
    assert max(off) < 0.35 and sum(off) / len(off) < 0.06


def test_sketches_merge_and_show_containment():
    rng = random.Random(4)
    part, whole = words(rng, 300, 10**6), words(rng, 9000, 10**6)
    a, b = fingerprints.sketch(part), fingerprints.sketch(whole + " " + part)
    assert fingerprints.likeness(a, b) == 1 and fingerprints.likeness(a, fingerprints.sketch(whole)) == 0
    joined = fingerprints.merged(a, fingerprints.sketch(whole))
    assert set(a) <= set(joined) and len(set(b) - set(joined)) <= 4  # shingles across the seam
    assert fingerprints.merged(fingerprints.sketch(""), a).tolist() == a.tolist()


def test_fingerprints_of_odd_tables(spark):
    schema = "doc_id long, text string"
    one = fingerprints.fingerprints(spark.createDataFrame([(4, "abc def")], schema)).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abc dab").hexdigest() and one[0].near_next == 1
    again = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (None, None), (None, "tail"), (2, "")], schema)
    found = fingerprints.fingerprints(again)
    assert found.count() == 5 and found.filter("near_next between 0 and 1").count() == 5
    assert fingerprints.fingerprints(again.limit(0)).count() == 0
    assert found.select(fingerprints.compared("fingerprint", F.lit("")).alias("p")).filter("p = 1").count() == 2


def test_one_row_of_each_group_stays_where_an_id_has_several_texts(spark):
    texts = {name: " ".join(f"{name}{i}" for i in range(30)) for name in "ghk"}
    rows = [(3, "g"), (5, "g"), (5, "h"), (8, "h"), (None, "k"), (None, "g"), (9, "k"), (9, "k")]
    data = [(i, texts[t], t, "x") for i, t in rows] + [(20, None, "-", "x"), (21, "", "-", "y"), (21, "", "-", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, name string, _key string")
    found = neardup.representatives(docs)
    assert found.columns == docs.columns
    assert sorted((r.doc_id, r.name, r._key) for r in found.collect()) == [
        (3, "g", "x"), (5, "h", "x"), (9, "k", "x"), (20, "-", "x"), (21, "-", "x"),
    ]
    assert neardup.representatives(docs.limit(0)).count() == 0


def test_components_of_heavy_nodes(spark, monkeypatch):
    """Stars around one node and chains of stars, with heavy nodes apart."""
    monkeypatch.setattr(components_module, "HEAVY", 20)
    edges = [(0, i) for i in range(1, 200)] + [(199, 300)] + [(300, i) for i in range(301, 400)] + [(500, 501), (501, 502)]
    found = {r.node: r.component for r in components_module.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in [*range(200), *range(300, 400)]}, 500: 500, 501: 500, 502: 500}


def test_links_inside_one_family_of_long_texts():
    """One block of a family: 40 texts of 20,000 shingles, in memory that is linear in them."""
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(-(1 << 62), 1 << 62, 20_000))
    rows = []
    for i in range(40):
        own = base.copy()
        own[rng.random(len(own)) < 0.004 * i] += 1
        rows.append({"id": bytes([i]), "part": bytes([i]), "shingles": np.unique(own), "query": i < 20})
    found = neardup._family_links(80)(pd.DataFrame(rows))
    want = set()
    for m in rows[20:]:
        for q in rows[:20]:
            both = len(np.intersect1d(m["shingles"], q["shingles"]))
            if 100 * both >= 80 * (len(m["shingles"]) + len(q["shingles"]) - both):
                want.add((m["id"], q["id"]))
    assert set(zip(found["a"], found["b"])) == want and 0 < len(want) < 400
