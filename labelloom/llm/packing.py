"""Packing of token pieces into sequences: dominance reduction, then best fit.

The instance is the number of items of each length, a table of at most ``capacity`` rows whatever
the corpus. On it, small sets of lengths that provably dominate every other way to fill a sequence
are fixed for good (Martello and Toth), as many copies at once as there are; what remains is placed
by best fit in falling order of length. The result is a list of runs, each saying where the items
of one length with ranks from ``first`` on go. Items get a rank inside their length from counts per
length and hash chunk, so a length that a third of all items share is spread over many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import free_unused, id_and_text, ship
from labelloom.llm.tokens import encoder
from labelloom.staging import stage

CAPACITY = 2048
#: Items per hash chunk that ranks aim at, and the least number of chunks.
CHUNK_ROWS = 50_000
LEAST_CHUNKS = 256


class Run(NamedTuple):
    """Items of ``length`` with ranks ``first .. first + n - 1``: ``each`` to a sequence, from ``offset`` on."""

    length: int
    first: int
    n: int
    sequence: int
    offset: int
    each: int


def dominating_set(counts: np.ndarray, w: int, capacity: int) -> tuple[int, ...] | None:
    """The lengths that can be fixed beside an item of length ``w`` at no loss, or None if no rule proves any.

    ``counts[l]`` is the number of items of length ``l``, with one of length ``w`` taken out. Let r be the room left.
    A set dominates another if what the other holds can be put in the places of its items, wherever those are:

    * nothing else fits: alone;
    * one item fills r: whatever else stood beside w fits in that item's place;
    * no two items fit: the longest that fits, k;
    * no three fit: k, if no pair sums to more than k; or k and the longest b beside it, if every pair that fits has
      an item of at most b (with k >= the other), or sums to at most k.
    """
    room = capacity - w
    there = np.flatnonzero(counts[: room + 1])
    if not len(there):
        return ()
    k = int(there[-1])
    if k == room:
        return (k,)
    smallest = np.repeat(there[:3], np.minimum(counts[there[:3]], 3))[:3]
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (k,)
    if len(smallest) == 3 and smallest.sum() <= room:
        return None
    if _longest_pair(counts, there, room) <= k:
        return (k,)
    counts[k] -= 1
    rest = np.flatnonzero(counts[: room - k + 1])
    counts[k] += 1
    if not len(rest):
        return None
    b = int(rest[-1])
    return (k, b) if _longest_pair(counts, there[there > b], room) <= k else None


def _longest_pair(counts: np.ndarray, lengths: np.ndarray, room: int) -> int:
    """The largest sum of two items that fits, 0 if none does."""
    low, high, best = 0, len(lengths) - 1, 0
    while low <= high:
        total = int(lengths[low] + lengths[high])
        if total > room:
            high -= 1
        elif low == high and counts[lengths[low]] < 2:
            break
        else:
            best = max(best, total)
            low += 1
    return best


def reduced(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Fix dominating sets until no rule applies: pairs of lengths and copies, and the counts that remain.

    Passes go over the lengths in falling order. A pass that fixes nothing ends them; every other one uses up a length
    or nearly so, so their number is bounded by the capacity and not by the items.
    """
    counts, fixed, changed = counts.copy(), [], True
    while changed:
        changed = False
        for w in range(capacity, 0, -1):
            while counts[w]:
                counts[w] -= 1
                beside = dominating_set(counts, w, capacity)
                counts[w] += 1
                if beside is None:
                    break
                lengths = (w, *beside)
                copies = min(int(counts[x]) // lengths.count(x) for x in lengths)
                fixed.append((lengths, copies))
                for x in lengths:
                    counts[x] -= copies
                changed = True
    return fixed, counts


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Run]:
    """Runs that place ``counts[l]`` items of each length ``l``."""
    fixed, rest = reduced(counts, capacity)
    ranks = np.zeros(capacity + 1, np.int64)
    runs: list[Run] = []
    sequences = 0

    def put(length: int, n: int, sequence: int, offset: int, each: int) -> None:
        runs.append(Run(length, int(ranks[length]), n, sequence, offset, each))
        ranks[length] += n

    for lengths, copies in fixed:
        offset = 0
        for length in lengths:
            put(length, copies, sequences, offset, 1)
            offset += length
        sequences += copies
    rooms: list[int] = []  # free room of open sequences, sorted
    open_: dict[int, list[tuple[int, int]]] = {}  # by room: first sequence and number of sequences in a row

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    for length in range(capacity, 0, -1):
        left = int(rest[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # no open sequence has room: open as many as are needed
                each = capacity // length
                keep(capacity, sequences, -(-left // each))
                sequences += -(-left // each)
                continue
            room = rooms[at]
            first, n = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            each = min(room // length, left)
            used = min(n, left // each)
            put(length, used * each, first, capacity - room, each)
            left -= used * each
            keep(room - each * length, first, used)
            keep(room, first + used, n - used)
    return runs


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Cut each whole text's ids, with id ``end`` after them, into pieces of at most ``capacity``.

    Gives ``doc_id, piece, start, length, ids_crc32``. Only longer documents are cut, and then the first piece is the
    shorter one. Null and empty texts give one piece of length 1; repeated rows give repeated pieces; other columns
    are not read; an empty table gives no pieces.
    """
    ship(docs.sparkSession)
    rows = id_and_text(docs, id_col, text)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = np.append(coder.ids(value.as_py()), end).astype("<u4")
                at, stop = 0, len(ids) % capacity or capacity
                for n in range(-(-len(ids) // capacity)):
                    row.append(i)
                    piece.append(n)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(ids[at:stop].tobytes()))
                    at, stop = stop, stop + capacity
            free_unused()
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            columns = [ids, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, schema)


def pack(items: DataFrame, keys: Sequence[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every item: sequences of at most ``capacity``, gapless from 0.

    Items of a length below 1 or above ``capacity`` (and null) are an error. ``keys`` tell items apart as far as they can
    be; rows equal in them are interchangeable. Columns named ``sequence_id`` or ``offset`` are replaced, other columns
    kept. An empty table stays empty.
    """
    spark = items.sparkSession
    own = [c for c in items.columns if c not in ("sequence_id", "offset")]
    staged = stage(items.select(*own), "items")
    bad = F.coalesce(~F.col(length).between(1, capacity), F.lit(True))
    total, wrong = staged.agg(F.count("*"), F.count(F.when(bad, 1))).first()
    if wrong:
        raise ValueError(f"{wrong} items have no length from 1 to {capacity}")
    chunks = max(LEAST_CHUNKS, 1 << (total // CHUNK_ROWS).bit_length())
    chunk = F.pmod(F.xxhash64(*keys), F.lit(chunks))
    counts = stage(staged.groupBy(F.col(length).alias("_length"), chunk.alias("_chunk")).agg(F.count("*").alias("_n")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for size, n in counts.groupBy("_length").agg(F.sum("_n")).collect():  # at most `capacity` rows
        histogram[size] = n
    runs = plan(histogram, capacity)
    earlier = Window.partitionBy("_length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_length", "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    # the row is carried whole, so that its columns may have any names
    names = [f"_k{i}" for i in range(len(keys))]
    ranked = staged.select(F.struct(*own).alias("_item"), F.col(length).cast("long").alias("_length"), chunk.alias("_chunk"), *[F.col(k).alias(n) for k, n in zip(keys, names)])
    inside = Window.partitionBy("_length", "_chunk").orderBy(*names)
    ranked = ranked.withColumn("_row", F.row_number().over(inside))
    ranked = ranked.join(firsts.withColumn("_length", F.col("_length").cast("long")), ["_length", "_chunk"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_row") - 1)
    # The runs depend on the capacity alone: a few for each length.
    placed = spark.createDataFrame(
        runs, "_l long, _first long, _count long, _sequence long, _offset long, _each long"
    )
    place = F.col("_rank") - F.col("_first")
    hit = (F.col("_length") == F.col("_l")) & (place >= 0) & (place < F.col("_count"))
    return ranked.join(F.broadcast(placed), hit).select(
        "_item.*",
        (F.col("_sequence") + F.floor(place / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + F.pmod(place, F.col("_each")) * F.col("_length")).alias("offset"),
    )
