"""Joins with tables of many keys, one of which holds a large part of the rows."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.operators import cuts, joins, quota, splits
from labelloom.staging import stage

STRATA = 120_000


@pytest.fixture
def beyond(monkeypatch):
    """No table counts as small."""
    monkeypatch.setattr(joins, "is_small", lambda df, *bounds: False)


@pytest.fixture
def plain_shuffles(spark):
    """Partitions of shuffles as they are, and no broadcast but those asked for."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def hot(spark, n, strata):
    """Two rows of five in one stratum, one of fifty in NULL, the others dealt to ``strata`` strata."""
    stratum = F.when(F.col("id") % 5 < 2, -1).when(F.col("id") % 50 == 3, None).otherwise(F.xxhash64("id") % strata)
    return spark.range(0, n, 1, 8).select(stratum.alias("g"), F.col("id").alias("key"))


def test_rows_are_those_of_a_plain_join(spark, beyond, monkeypatch):
    monkeypatch.setattr(joins, "_SHARE", 20)
    rows = hot(spark, 3000, 60)
    table = stage(rows.filter("g is null or g % 3 <> 1").groupBy("g").agg(F.max("key").alias("most")), "most")
    found = joins.join_heavy_apart(rows, table, ["g"])
    assert found.columns == ["g", "key", "most"]
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, joins.join_null_safe(rows, table, ["g"]).collect()))
    heavy = {r.g for r in joins.heavy_keys(rows, ["g"]).collect()}
    assert heavy == {g for g, n in Counter(r.g for r in rows.collect()).items() if n > 3000 / 20} and -1 in heavy
    for none in (rows.limit(0), rows.filter("key < 0")):
        assert joins.join_heavy_apart(none, table, ["g"]).count() == 0
    assert joins.join_heavy_apart(rows, table.limit(0), ["g"]).count() == 0


def test_no_task_holds_the_heavy_key(spark, beyond, plain_shuffles):
    rows = hot(spark, 400_000, STRATA)
    table = stage(rows.groupBy("g").agg(F.max("key").alias("most")), "most")

    def sizes(joined):
        return sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())

    apart, together = sizes(joins.join_heavy_apart(rows, table, ["g"])), sizes(joins.join_null_safe(rows, table, ["g"]))
    assert sum(apart) == sum(together) == 400_000
    assert together[-1] > 3 * together[len(together) // 2]  # what is to be avoided
    assert apart[-1] < 2 * apart[len(apart) // 2]


def test_cuts_and_quotas_of_many_strata(spark, beyond, monkeypatch):
    """All ways that join rows with a table of groups, with brackets in the hot one."""
    for name, value in (("_RANKED_ROWS", 1000), ("_SAMPLE", 300)):
        monkeypatch.setattr(cuts, name, value)
    monkeypatch.setattr(joins, "_SHARE", 25)
    rows = hot(spark, 6000, 300).withColumn("at", F.col("key") * 7919 % 6007)
    members = {}
    for r in rows.collect():
        members.setdefault(r.g, []).append(r["at"])
    found = {r.g: r.last for r in cuts.range_cuts(rows, ["at"], {"last": lambda n: n - 1}, ["g"]).collect()}
    assert found == {g: max(own) for g, own in members.items()}
    split = Counter((r.g, r.split) for r in splits.split_stratified(rows, ["key"], ["g"], seed=3).collect())
    for g, own in members.items():
        n = len(own)
        train, val = int(0.8 * n), int(0.1 * n)
        assert [split[g, s] for s in ("train", "val", "test")] == [train, val, n - train - val]
    remaining = rows.select("g").distinct().withColumn("remaining", F.when(F.col("g") == -1, 1700).otherwise(4).cast("long"))
    got = quota.accept_to_quota(rows, remaining, ["at"], ["g"]).collect()
    want = [(g, at) for g, own in members.items() if g is not None for at in sorted(own)[: 1700 if g == -1 else 4]]
    assert Counter((r.g, r["at"]) for r in got) == Counter(want)  # rows without a category fill none
