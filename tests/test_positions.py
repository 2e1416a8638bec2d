"""Positions and cuts against plain Python, with a group that holds most rows."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from labelloom.operators import cuts, positions, splits


@pytest.fixture(scope="module")
def skewed(spark):
    """5,000 rows: one group with 80 % of them, small groups, and a NULL group."""
    k = F.col("id")
    group = F.when(k < 4000, "hot").when(k % 97 == 0, None).otherwise(F.concat(F.lit("g"), (k % 7).cast("string")))
    return spark.range(5000).select(group.alias("g"), (k * 7919 % 5003).alias("key"), (k % 3).alias("part"))


def by_group(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["g"], []).append(r)
    return groups


def test_positions_of_a_table(skewed):
    rows = positions.with_positions(skewed, ["key"], total="n").collect()
    assert [r.pos for r in sorted(rows, key=lambda r: r.key)] == list(range(5000))
    assert {r.n for r in rows} == {5000}


def test_positions_with_a_composite_key(skewed):
    rows = positions.with_positions(skewed, ["part", "key"], partitions=5).collect()
    assert [r.pos for r in sorted(rows, key=lambda r: (r.part, r.key))] == list(range(5000))


@pytest.mark.parametrize("method", ["xxhash64", "md5"])
@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 1025])
def test_the_order_of_an_epoch_is_a_permutation(spark, n, method):
    rows = spark.range(n).select(*[positions.permuted(F.col("id"), n, f"0-{e}", method).alias(f"e{e}") for e in range(3)]).collect()
    orders = [[r[e] for r in rows] for e in range(3)]
    assert all(sorted(order) == list(range(n)) for order in orders)
    if n >= 64:
        assert all(sum(a == b for a, b in zip(x, y)) < 12 for x in orders for y in [*orders, list(range(n))] if x is not y)
        assert all(sum(abs(a - b) == 1 for a, b in zip(x, x[1:])) < 16 for x in orders)


def test_epochs_need_no_shuffle(spark):
    placed = spark.range(1000, numPartitions=4).withColumnRenamed("id", "pos")
    df = splits.epoch_batches(placed, 32, seed=5, epoch=3)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    rows = df.collect()
    assert sorted(r.place for r in rows) == list(range(1000)) and all(r.batch == r.place // 32 for r in rows)
    assert rows == splits.epoch_batches(placed, 32, seed=5, epoch=3, n=1000).collect()
    assert splits.epoch_batches(placed.limit(0), 32).count() == 0


def test_positions_in_groups(skewed):
    rows = positions.with_positions(skewed, ["key"], ["g"], total="n").collect()
    assert len(rows) == 5000
    for members in by_group(rows).values():
        assert [r.pos for r in sorted(members, key=lambda r: r.key)] == list(range(len(members)))
        assert {r.n for r in members} == {len(members)}


def rank_of(skewed, seed, method):
    """Key to its place in hash order."""
    if method == "md5":
        hashes = [(hashlib.md5(f"{r.key}-{seed}".encode()).hexdigest(), r.key) for r in skewed.collect()]
    else:
        hashes = skewed.select(F.xxhash64("key", F.lit(str(seed))), "key").collect()
    return {key: place for place, (_, key) in enumerate(sorted(map(tuple, hashes)))}


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_hash_positions(skewed, method):
    rows = positions.with_hash_positions(skewed, ["key"], 3, method=method).collect()
    assert {r.key: r.pos for r in rows} == rank_of(skewed, 3, method)


@pytest.mark.parametrize("n,want", [(10, (8, 1, 1)), (5, (4, 0, 1)), (1, (0, 0, 1)), (0, (0, 0, 0)), (1000, (800, 100, 100))])
def test_split_ordered(spark, n, want):
    df = spark.range(n).select((F.lit(n) - F.col("id")).alias("k"))
    rows = splits.split_ordered(df, ["k"]).collect()
    ordered = [r.split for r in sorted(rows, key=lambda r: r.k)]
    assert ordered == ["train"] * want[0] + ["val"] * want[1] + ["test"] * want[2]


@pytest.mark.parametrize("n", [0, 1, 5, 10, 1000])
def test_split_positions(spark, n):
    numbered = positions.with_positions(spark.range(n).select((F.lit(n) - F.col("id")).alias("k")), ["k"], total="n")
    got = sorted((r.k, r.split, r.pos) for r in splits.split_positions(numbered, total="n").collect())
    whole = {r.k: r.split for r in splits.split_ordered(spark.range(n).select((F.lit(n) - F.col("id")).alias("k")), ["k"]).collect()}
    seen = {"train": 0, "val": 0, "test": 0}
    for k, split, pos in got:
        assert split == whole[k] and pos == seen[split]
        seen[split] += 1


def test_split_ordered_without_a_test_part(spark):
    rows = splits.split_ordered(spark.range(20), ["id"], 0.5, 0.5).collect()
    assert [r.split for r in sorted(rows)] == ["train"] * 10 + ["val"] * 10


def test_split_ordered_by_two_columns(skewed):
    rows = splits.split_ordered(skewed, ["part", "key"]).collect()
    ordered = [r.split for r in sorted(rows, key=lambda r: (r.part, r.key))]
    assert ordered == ["train"] * 4000 + ["val"] * 500 + ["test"] * 500


@pytest.mark.parametrize("n,tail", [(30, 3), (5, 0), (0, 0)])
def test_tail_holdout(spark, n, tail):
    kept = splits.tail_holdout(spark.range(n), ["id"]).collect()
    assert sorted(r.id for r in kept if r.split == "train") == list(range(n))
    assert sorted(r.id for r in kept if r.split == "test") == list(range(n - tail, n))
    apart = splits.tail_holdout(spark.range(n), ["id"], exclude_from_train=True).collect()
    assert sorted(r.id for r in apart if r.split == "train") == list(range(n - tail))
    assert sorted(r.id for r in apart if r.split == "test") == list(range(n - tail, n))


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_split_stratified(skewed, method):
    place = rank_of(skewed, 5, method)
    rows = splits.split_stratified(skewed, ["key"], ["g"], seed=5, method=method).collect()
    assert len(rows) == 5000
    for members in by_group(rows).values():
        n = len(members)
        ordered = sorted(members, key=lambda r: place[r.key])
        train, val = int(0.8 * n), int(0.1 * n)
        assert [r.split for r in ordered] == ["train"] * train + ["val"] * val + ["test"] * (n - train - val)


def test_both_kinds_of_cuts_past_the_end(skewed):
    ranks = {"c": lambda n: n, "d": lambda n: n - 1}
    for found in (cuts.range_cuts(skewed, ["key"], ranks, ["g"]), cuts.hash_cuts(skewed, ["key"], 0, ranks, ["g"])):
        rows = found.collect()
        assert {r.g for r in rows} == {r.g for r in skewed.select("g").distinct().collect()}
        assert all(r.c is None and r.d is not None for r in rows)


RANKS = {"first": lambda n: n - n, "middle": lambda n: F.floor(n * 0.5), "late": lambda n: F.floor(n * 0.9), "end": lambda n: n}


def expected_cuts(rows, key):
    out = {}
    for group, members in by_group(rows).items():
        ordered = sorted((key(r) for r in members), key=lambda k: (k is not None, k))
        n = len(ordered)
        out[group] = (ordered[0], ordered[n // 2], ordered[int(n * 0.9)], None)
    return out


@pytest.mark.parametrize("ranked,sample,errors", [(100_000, 4000, 4.0), (300, 150, 4.0), (300, 100, 0.0)])
def test_range_cuts(skewed, monkeypatch, ranked, sample, errors):
    """Ranked at once, by brackets of brackets, and with brackets so narrow that ranks fall outside; NULL keys and ties."""
    for name, value in (("_RANKED_ROWS", ranked), ("_SAMPLE", sample), ("_ERRORS", errors)):
        monkeypatch.setattr(cuts, name, value)
    rows = skewed.withColumn("key", F.when(F.col("key") % 11 != 0, F.col("key") % 700))
    found = {r["g"]: tuple(r[1:]) for r in cuts.range_cuts(rows, ["key"], RANKS, ["g"]).collect()}
    assert found == expected_cuts(rows.collect(), lambda r: r["key"])


def test_range_cuts_of_many_equal_keys(spark):
    rows = spark.range(300_000).selectExpr("if(id < 299000, 7, id) AS key", "'a' AS g")
    assert cuts.range_cuts(rows, ["key"], RANKS).collect() == [(7, 7, 7, None)]
    assert cuts.range_cuts(rows, ["key"], RANKS, ["g"]).collect() == [("a", 7, 7, 7, None)]


def test_range_cuts_of_many_groups(spark, monkeypatch):
    """2,000 groups, one with nine tenths of the rows; keys of two columns."""
    monkeypatch.setattr(cuts, "_RANKED_ROWS", 1000)
    monkeypatch.setattr(cuts, "_SAMPLE", 200)
    rows = spark.range(60_000).selectExpr("if(id % 10 < 9, -1, id div 10 % 2000) AS g", "id * 7919 % 211 AS x", "id * 31 % 60013 AS y")
    found = {r["g"]: tuple(r[1:]) for r in cuts.range_cuts(rows, ["x", "y"], RANKS, ["g"]).collect()}
    assert len(found) == 2001
    assert found == expected_cuts(rows.collect(), lambda r: (r["x"], r["y"]))


def test_range_cuts_of_nothing(spark):
    none = spark.range(0).selectExpr("id AS key", "id AS g")
    assert cuts.range_cuts(none, ["key"], RANKS).collect() == [(None, None, None, None)]
    assert cuts.range_cuts(none, ["key"], RANKS, ["g"]).collect() == []


def test_batches(skewed):
    rows = splits.shuffle_into_batches(skewed, ["key"], 16, seed=1, epoch=2).collect()
    assert sorted(r.pos for r in rows) == list(range(5000))
    assert all(r.batch == r.pos // 16 for r in rows)
    other = splits.shuffle_into_batches(skewed, ["key"], 16, seed=1, epoch=3).collect()
    assert {r.key: r.pos for r in rows} != {r.key: r.pos for r in other}


def test_ids(spark):
    df = spark.createDataFrame([("train", 0), ("train", 5), ("val", 0)], "split string, pos bigint")
    ids = [r.id for r in splits.assign_ids(df).collect()]
    assert [i[:5] for i in ids] == ["10000", "10005", "10000"]
    assert all(len(i) == 8 and i[5:].isalpha() and i[5:].isupper() for i in ids)
    assert len(set(ids)) == 3
    assert ids == [r.id for r in splits.assign_ids(df).collect()]


def test_preview_and_profile(skewed):
    assert [r.key for r in splits.preview(skewed, ["key"], 3).collect()] == [0, 1, 2]
    profile = splits.profile_splits(splits.split_ordered(skewed, ["key"])).collect()
    assert {(r.split, r.n_rows, r.n_columns) for r in profile} == {("train", 4000, 3), ("val", 500, 3), ("test", 500, 3)}
