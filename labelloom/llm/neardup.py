"""Near-duplicate documents by MinHash with tensored banding, links confirmed on full shingle sets.

A document has two small collections of ``M`` band values, each made of ``K`` minhashes. The M * M
table keys are all pairs of a value of the first and a value of the second collection, so 2 * M * K
minhashes do the work of M * M * 2 * K. A link at the threshold shares no key with probability of at
most 2 * (1 - t ** K) ** M, about 1.5e-4 for t = 0.85, K = 3, M = 10.

Equal sets are one class and never paired. In every bucket the classes are first compared with one
member picked by hash, which settles groups of true copies in as many comparisons as members. Where
a bucket still spans several components, exactness needs the other pairs too: the classes of such
buckets form families, and in each the members outside its largest component are compared with all
of its members, in blocks of bounded size, inside tasks that return only the links. No pair is
emitted that has not been confirmed, and no bucket is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import free_unused, id_and_text, ship, whole_text
from labelloom.llm.components import components
from labelloom.llm.shingles import mixed, shingle_hashes
from labelloom.operators.joins import broadcast_if_small
from labelloom.staging import stage

K, M = 3, 10
#: Members and query members of a family that meet in one task.
MEMBERS, QUERIES = 1024, 128
#: Sets sent on together.
SETS = 500


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 4 * M * K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    values = mixed(seeds)
    return values[: 2 * M * K] | np.uint64(1), values[2 * M * K :]


def bands(hashes: np.ndarray, multipliers: np.ndarray, additions: np.ndarray) -> np.ndarray:
    """The 2 * M band values of a set: 32-bit hashes of K minhashes each."""
    mins = np.array([(hashes * m + a).min() for m, a in zip(multipliers, additions)], np.uint64).reshape(2 * M, K)
    value = np.zeros(2 * M, np.uint64)
    for i in range(K):
        value = mixed(value * np.uint64(3) + mins[:, i])
    return (value >> np.uint64(32)).astype(np.uint32).view(np.int32)


def set_id(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, set_id, a, b`` of every document; ``set_id`` is null for an empty set."""
    ship(docs.sparkSession)
    rows = id_and_text(docs, id_col, text)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers, additions = _multipliers()
        for batch in batches:
            n, sets, a, b = [], [], [], []
            for value in batch.column(1):
                hashes = shingle_hashes(value.as_py(), width)
                n.append(len(hashes))
                if len(hashes):
                    found = bands(hashes, multipliers, additions)
                    sets.append(set_id(hashes))
                    a.append(found[:M])
                    b.append(found[M:])
                else:
                    sets.append(None)
                    a.append(None)
                    b.append(None)
            free_unused()
            columns = [pa.array(n, pa.int64()), pa.array(sets, pa.binary()), *(pa.array(x, pa.list_(pa.int32())) for x in (a, b))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_shingles", "set_id", "a", "b"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, set_id binary, a array<int>, b array<int>")


def shingle_sets(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """``id, shingles``: the sorted distinct shingle hashes of every document, as signed numbers, by the set's id."""
    rows = docs.select(whole_text(docs, text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SETS):
                found = [shingle_hashes(value.as_py(), width) for value in batch.column(0).slice(start, SETS)]
                ids = pa.array(map(set_id, found), pa.binary())
                sets = pa.array([np.sort(hashes.view(np.int64)) for hashes in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, sets], names=["id", "shingles"])
            free_unused()

    return rows.mapInArrow(run, "id binary, shingles array<bigint>")


def table_keys(classes: DataFrame) -> DataFrame:
    """``cls, n, key`` for the keys of classes that share a value of the first collection with another class."""
    first = classes.select("cls", "n", "b", F.posexplode("a").alias("i", "x"))
    shared = first.groupBy("i", "x").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    pairs = first.join(shared, ["i", "x"]).select("cls", "n", "i", "x", F.posexplode("b").alias("j", "y"))
    return pairs.select("cls", "n", F.xxhash64("i", "x", "j", "y").alias("key"))


def similar(low: int, high_n, n, both) -> F.Column:
    """100 * intersection >= low * union, in whole numbers."""
    return 100 * both >= low * (high_n + n - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs ``a, b`` those whose full sets are similar."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(similar(percent, F.size("sa"), F.size("sb"), common)).select("a", "b")


def _family_links(percent: int):
    """Links between the query members and all members of one block of a family."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        queries, members = block[block["query"]], block[~block["query"]]
        # every shingle of the queries with the query it is from, by shingle: as large as the texts themselves
        sizes = queries["shingles"].map(len).to_numpy(np.int64)
        held = np.concatenate([*queries["shingles"], np.empty(0, np.int64)])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], np.repeat(np.arange(len(queries)), sizes)[order]
        parts, ids = queries["part"].to_numpy(), queries["id"].to_numpy()
        a, b = [], []
        for cls, part, found in zip(members["id"], members["part"], members["shingles"]):
            low, high = np.searchsorted(held, found, "left"), np.searchsorted(held, found, "right")
            n = high - low
            common = np.bincount(owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(queries))
            hit = (100 * common >= percent * (sizes + len(found) - common)) & (parts != part)
            other = ids[hit]
            a.extend([cls] * len(other))
            b.extend(other.tolist())
        free_unused()
        return pd.DataFrame({"a": a, "b": b})

    return run


def _residual_links(keys: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links that the comparisons with one member of each bucket have not looked for."""
    placed = keys.join(parts.withColumnRenamed("node", "cls"), "cls", "left")
    placed = stage(placed.select("cls", "key", F.coalesce("component", "cls").alias("part")), "placed")
    spans = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("cls").alias("hub"))
    open_ = placed.join(spans.filter("lo < hi").select("key", "hub"), "key").select("cls", "part", "hub").distinct()
    open_ = stage(open_, "open")
    if open_.isEmpty():
        return None
    families = components(open_.select(F.col("cls").alias("a"), F.col("hub").alias("b")))
    members = open_.select("cls", "part").distinct().join(families.withColumnRenamed("node", "cls"), "cls")
    members = stage(members.withColumnRenamed("component", "family"), "members")
    sizes = members.groupBy("family", "part").agg(F.count("*").alias("size"))
    main = sizes.groupBy("family").agg(
        F.max(F.struct("size", "part"))["part"].alias("main"),
        F.sum("size").alias("total"),
        (F.sum("size") - F.max("size")).alias("rest"),
    )
    cut = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    main = stage(main.select("family", "main", cut("rest", QUERIES).alias("q"), cut("total", MEMBERS).alias("m")), "families")
    rows = members.join(main, "family").withColumn("h", F.xxhash64("cls"))
    own_q, own_m = F.pmod("h", "q").cast("int"), F.pmod(F.shiftright("h", 20), "m").cast("int")
    asked = rows.filter("part <> main").select(
        "family", own_q.alias("bq"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("bm"), "cls", "part", F.lit(True).alias("query")
    )
    there = rows.select(
        "family", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("bq"), own_m.alias("bm"), "cls", "part", F.lit(False).alias("query")
    )
    blocks = asked.unionAll(there).withColumnRenamed("cls", "id").join(sets, "id")
    return blocks.groupBy("family", "bq", "bm").applyInPandas(_family_links(percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked if the Jaccard similarity of their sets of ``width``-word shingles is at least ``percent`` in a
    hundred; components are those of all links, named by their smallest id. Null, empty and wordless texts have an empty
    set and are linked with nothing. Repeated rows are copies of each other, also where one id has several texts. Rows
    with a null id belong to the component of an equal set but start no links themselves; if no row with an id has the
    same set, their component is null and they are kept. The smallest id is kept, so there are no ties. Other columns are
    not read. An empty table gives an empty table.
    """
    found = stage(signatures(docs, width, id_col, text), "signatures")
    classes = found.filter("set_id is not null").groupBy(F.col("set_id").alias("cls")).agg(
        F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")
    )
    classes = stage(classes, "classes")
    keys = stage(table_keys(classes.filter("low is not null")), "keys")
    pick = F.min(F.struct(F.xxhash64("cls", "key").alias("h"), F.col("cls").alias("hub"), F.col("n").alias("hub_n")))
    hubs = keys.groupBy("key").agg(pick.alias("p"), F.count("*").alias("_n")).filter("_n > 1").select("key", "p.hub", "p.hub_n")
    keys = stage(keys.join(hubs, "key"), "buckets")
    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    pairs = keys.filter(fits & (F.col("cls") != F.col("hub")))
    pairs = stage(pairs.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct(), "pairs")
    wanted = keys.select("cls").distinct().join(classes.select("cls", "low"), "cls").select(F.col("low").alias("_id"))
    wanted = broadcast_if_small(stage(wanted, "wanted"))
    chosen = docs.select(docs[id_col].alias("_doc"), docs[text].alias("text")).join(wanted, F.col("_doc") == F.col("_id"), "left_semi")
    sets = stage(shingle_sets(chosen, width), "sets")
    links = stage(_confirmed(pairs, sets, percent), "links")
    parts = components(links)
    more = _residual_links(keys, parts, sets, percent)
    if more is not None:
        parts = components(links.unionAll(more))
    placed = classes.join(parts, classes["cls"] == parts["node"], "left")
    placed = stage(placed.select("cls", F.coalesce("component", "cls").alias("part"), "low"), "components")
    lows = placed.groupBy("part").agg(F.min("low").alias("component_id"))
    named = placed.select("cls", "part").join(lows, "part").select(F.col("cls").alias("set_id"), "component_id")
    out = found.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that with the smallest id.

    Rows are told apart by id and text, so an id with several texts is decided for each of them, and no group is lost
    because another text of its id belongs to a second group. Of rows with one id and one text the smallest in its other
    columns stays. Null ids come after all others; null, empty and wordless texts are in no group, but equal rows of
    them still are copies of each other. An empty table stays empty.
    """
    own = docs.columns
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    rows = docs.select(F.struct(*own).alias("_row"), key.alias("_key"))
    found = near_duplicates(rows.select("_key", F.col("_row")[text].alias("text")), width, percent, "_key")
    found = stage(found.groupBy(F.col("doc_id").alias("_own")).agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")), "decided")
    gone = broadcast_if_small(found.filter("not kept").select("_own"))
    kept = rows.join(gone, F.col("_key") == F.col("_own"), "left_anti")
    again = found.filter("kept and n > 1").select("_own")
    if again.isEmpty():
        return kept.select("_row.*")
    again = broadcast_if_small(again)
    first = kept.join(again, F.col("_key") == F.col("_own"), "left_semi").groupBy("_key").agg(F.min("_row").alias("_row"))
    return kept.join(again, F.col("_key") == F.col("_own"), "left_anti").select("_row.*").unionByName(first.select("_row.*"))
