"""Language-model scores of texts, from a log-frequency Bloom filter of n-gram counts.

Counts of words and of pairs of words are quantised by their logarithm, and an n-gram of level q goes
into a Bloom filter as q events, (n-gram, 1) to (n-gram, q) (Talbot and Osborne 2007). Its level is read
back by probing 1, 2, 3, ... until an event is missing. So the filter needs some bits for each event, no
matter how long n-grams are, its counts are never too small, and one that is too large is the rarer the
larger the error. Probabilities come from such probes alone: the share of a word after the word before
it, smoothed by the word's own share.

The filter grows with the corpus. It is made of shards, each for a range of hashes and of bounded size,
built by one task each. While all of them together have at most ``MOST_SENT`` bytes they are broadcast
and every text is scored where it is read. Beyond that the probes go to the shards instead: distinct
n-grams of blocks of texts are sent to the tasks that hold their shards, and levels come back. The
shards, and so the scores, are the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm import lookup
from labelloom.llm.bpe import slices
from labelloom.llm.common import free_unused, id_and_text, ship
from labelloom.llm.shingles import mixed, words
from labelloom.staging import stage

#: Levels are whole logarithms to this base, plus 1. Higher ones than the last are not told apart.
LEVEL_BASE, LEVELS = 1.5, 100
#: Bits looked at for each event: one that is not there is seen with a probability of 2 ** -PROBES.
PROBES = 5
#: Bytes of a filter that is broadcast.
MOST_SENT = 128 << 20
#: Bytes of text for each shard, fewest shards, and n-grams counted together in a task.
SHARD_BYTES, LEAST_SHARDS, SLICE_KEYS = 8 << 20, 256, 2_000_000
#: Characters of texts whose probes are sent to the shards together.
BLOCK = 8_000_000
#: Weight, in words, of a word's own share against its share after the word before it.
PRIOR = 50.0

_START, _END = np.uint64(xxhash.xxh3_64_intdigest(b" start")), np.uint64(xxhash.xxh3_64_intdigest(b" end"))
_SECOND = 0x9E3779B97F4A7C15


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts, words and one end each, of the pairs that end with them, and each one's text."""
    parts, sizes = [], []
    for text in texts:
        found = words(text)
        parts.extend(found)
        parts.append(b" end")
        sizes.append(len(found) + 1)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    row = np.repeat(np.arange(len(texts)), sizes)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.cumsum(sizes)[:-1]] = _START
    before[:1] = _START
    return own, mixed(mixed(before) + own), row


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log(counts) / math.log(LEVEL_BASE) + 1e-9).astype(np.int64) + 1, LEVELS)


def counts_by_level() -> np.ndarray:
    """By level, from 0: the middle of the counts that have it."""
    first = np.ceil(LEVEL_BASE ** np.arange(LEVELS + 1) - 1e-9)
    return np.concatenate([[0.0], (first[:-1] + np.maximum(first[1:] - 1, first[:-1])) / 2])


def _bits(keys: np.ndarray, level: int, size: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of an event in filters of so many bits."""
    first = mixed(keys + np.uint64(level * _SECOND & 0xFFFFFFFFFFFFFFFF))
    step = mixed(first ^ np.uint64(_SECOND)) | np.uint64(1)
    for _ in range(PROBES):
        yield (first % size).astype(np.int64)
        first = first + step


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """``shards``, a power of two, ranges of hashes."""
    return (keys >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64)


def built(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, int]:
    """A filter for distinct n-grams, as bytes, and its number of bits, a multiple of 8."""
    level = levels_of(counts)
    size = max(8, math.ceil(int(level.sum()) * PROBES / math.log(2) / 8) * 8)
    bits = np.zeros(size, bool)
    for i in range(1, int(level.max(initial=0)) + 1):
        for bit in _bits(keys[level >= i], i, np.uint64(size)):
            bits[bit] = True
    return np.packbits(bits, bitorder="little").tobytes(), size


class Filter:
    """Shards of a filter in one array of bytes."""

    def __init__(self, shards: int, parts: Iterator[tuple[int, bytes]], n_bytes: int) -> None:
        self.shards, self.bytes = shards, np.zeros(n_bytes, np.uint8)
        self.start, self.size = np.zeros(shards, np.int64), np.zeros(shards, np.uint64)
        used = 0
        for shard, part in parts:
            self.bytes[used : used + len(part)] = np.frombuffer(part, np.uint8)
            self.start[shard], self.size[shard] = used, 8 * len(part)
            used += len(part)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 if it is not there, by probing one level after the other."""
        out = np.zeros(len(keys), np.int64)
        shard = shard_of(keys, self.shards)
        there = np.flatnonzero(self.size[shard])
        for level in range(1, LEVELS + 1):
            if not len(there):
                break
            own = shard[there]
            start, held = self.start[own], np.ones(len(there), bool)
            for bit in _bits(keys[there], level, self.size[own]):
                held &= (self.bytes[start + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1
            there = there[held]
            out[there] = level
        return out


class Figures:
    """What a model needs beside its filter: numbers of training tokens, of distinct ones and of texts."""

    def __init__(self, tokens: int, distinct: int, texts: int) -> None:
        self.tokens, self.distinct, self.texts = tokens, distinct, texts

    @property
    def whole(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


Levels = Callable[[np.ndarray], np.ndarray]


def scores(texts: list[str], levels: Levels, figures: Figures, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log10 probability of each text, and its token hashes with their texts."""
    own, pairs, row = keys_of(texts)
    count = counts_by_level()
    distinct, at = np.unique(own, return_inverse=True)
    alone = count[levels(distinct)][at]
    distinct, at = np.unique(pairs, return_inverse=True)
    together = count[levels(distinct)][at]
    before = np.empty_like(alone)
    before[1:] = alone[:-1]
    before[np.flatnonzero(np.diff(row, prepend=-1))] = figures.texts
    share = (alone + 0.5) / figures.whole
    smooth = (np.minimum(together, before) + prior * share) / (before + prior)
    return np.bincount(row, np.log10(smooth), len(texts)), own, row


def _gathered(docs: DataFrame, shards: int) -> DataFrame:
    """Counts of n-grams by task and shard, packed: ``shard, pairs, keys, counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def added() -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            for order, parts in enumerate(held):
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                parts.clear()
                owner = shard_of(keys, shards)
                ends = np.searchsorted(owner, np.arange(shards + 1))
                for shard in np.unique(owner).tolist():
                    span = slice(ends[shard], ends[shard + 1])
                    for column, value in zip(out, (shard, order == 1, keys[span].tobytes(), counts[span].astype(np.int32).tobytes())):
                        column.append(value)
            kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["shard", "pairs", "keys", "counts"])

        for batch in batches:
            for _, texts in slices(batch, 0):
                own, pairs, _ = keys_of(texts)
                held[0].append(own)
                held[1].append(pairs)
                if sum(map(len, held[0])) > SLICE_KEYS:
                    yield added()
            free_unused()
        if held[0]:
            yield added()

    return docs.mapInArrow(run, "shard int, pairs boolean, keys binary, counts binary")


def _merged(table: pa.Table, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one kind and the sums of their counts."""
    rows = table.filter(pc.equal(table.column("pairs"), pairs))
    keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.uint64)
    counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.int32)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


SHARD = "shard int, words binary, counts binary, tokens long, distinct long, bits binary"


def _shard(table: pa.Table) -> pa.Table:
    """One shard: its words with exact counts, and the filter of its words and pairs."""
    own, n_own = _merged(table, False)
    both, n_both = _merged(table, True)
    bits, _ = built(np.concatenate([own, both]), np.concatenate([n_own, n_both]))
    row = {"shard": table.column("shard")[0].as_py(), "words": own.tobytes(), "counts": n_own.tobytes()}
    row |= {"tokens": int(n_own.sum()), "distinct": len(own), "bits": bits}
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))


class Model:
    """A fitted model: the staged shards and exact word counts, and figures."""

    def __init__(self, docs: DataFrame, text: str = "text") -> None:
        ship(docs.sparkSession)
        rows = docs.select(F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
        size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
        wanted = max(LEAST_SHARDS, math.ceil((size["bytes"] or 0) / SHARD_BYTES))
        self.shards = 1 << (wanted - 1).bit_length()
        gathered = _gathered(rows, self.shards)
        self.table = stage(gathered.groupBy("shard").applyInArrow(_shard, SHARD), "ngram-shards")
        found = self.table.agg(F.sum("tokens").alias("t"), F.sum("distinct").alias("d"), F.sum(F.octet_length("bits")).alias("b")).first()
        self.figures = Figures(found["t"] or 0, found["d"] or 0, size["n"])
        self.n_bytes = found["b"] or 0
        self.counts = stage(self.table.select("words", "counts").mapInArrow(_unpacked, "key long, n long"), "word-counts")

    def filter(self) -> Filter:
        """All shards in the driver; only for filters of at most ``MOST_SENT`` bytes."""
        rows = self.table.select("shard", "bits").toLocalIterator()
        return Filter(self.shards, ((r["shard"], bytes(r["bits"])) for r in rows), self.n_bytes)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own, counts in zip(batch.column(0), batch.column(1)):
            arrays = [pa.array(np.frombuffer(own.as_py(), np.int64)), pa.array(np.frombuffer(counts.as_py(), np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n"])


def held_out(doc_id: Column) -> Column:
    """Whether the checksum of an id as text leaves 1 when divided by 5. A null id has none and is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


_PARTS = ("n_tokens", "score", "known", "gain")


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", most_sent: int = MOST_SENT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    Tokens are words between ASCII white space (0x20, 0x09-0x0D) with A-Z lower-cased, and one end. ``base_score`` adds
    log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens with exact counts; ``score`` is the model's. ``n_known`` counts tokens
    seen in training. Null and empty texts have the end alone. Without training texts every count is 0 and both scores
    are 0. Repeated rows give repeated results, null ids stay null, other columns are not read. An empty table gives an
    empty table. Words are told apart by hashes of 64 bits.
    """
    ship(docs.sparkSession)
    figures = model.figures
    gain = F.log10(2 * F.col("n") + 1)  # against a word that was not seen
    table = model.counts.select("key", "n", F.lit(1).cast("long").alias("known"), gain.alias("gain"))
    context = docs.sparkSession.sparkContext
    head = context.broadcast(lookup.head_of(table, ["known", "gain"], "n"))

    def parts(texts: list[str], levels: Levels) -> list[pa.Array]:
        score, own, row = scores(texts, levels, figures)
        order = np.lexsort((own, row))
        own, row = own[order], row[order]
        first = np.flatnonzero((np.diff(own, prepend=~own[:1]) != 0) | (np.diff(row, prepend=-1) != 0))
        times = np.diff(np.append(first, len(own)))
        sums, rest = head.value.split(own[first].view(np.int64), times, row[first], len(texts))
        return [pa.array(np.bincount(row, minlength=len(texts))), pa.array(score), *map(pa.array, sums), rest]

    rows = id_and_text(docs, id_col, text)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, score double, known long, gain double, _rest {lookup.REST}"
    names = ["doc_id", *_PARTS, "_rest"]
    if model.n_bytes <= most_sent:
        sent = context.broadcast(model.filter())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch, 1):
                    yield pa.RecordBatch.from_arrays([part.column(0), *parts(texts, sent.value.levels)], names=names)
                    free_unused()

        found = rows.mapInArrow(run, schema)
    else:
        found = _by_shards(rows, model, parts, schema, names)
    staged = lookup.numbered(found, "scores")
    sums = lookup.with_rest(staged, table, ["known", "gain"])
    base = F.col("n_tokens") * math.log10(0.5 / figures.whole) + F.col("gain")
    both = staged.drop("known", "gain", "_rest").join(sums, "_row")
    return both.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(figures.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )


def _by_shards(rows: DataFrame, model: Model, parts: Callable, schema: str, names: list[str]) -> DataFrame:
    """Scores where the filter is too large to be sent: probes of each block of texts go to the shards."""
    shards = model.shards

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            number = []
            for text in batch.column(1):
                size += len(text.as_py())
                number.append(block)
                if size > BLOCK:
                    block, size = block + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64())], names=["doc_id", "text", "block"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = stage(rows.mapInArrow(dealt, f"doc_id {kind}, text string, block long"), "blocks")

    def probes(table: pa.Table) -> pa.Table:
        own, pairs, _ = keys_of(table.column("text").to_pylist())
        keys = np.unique(np.concatenate([own, pairs]))
        owner = shard_of(keys, shards)
        there = np.unique(owner)
        ends = np.searchsorted(owner, np.append(there, shards))
        packed = [keys[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        block = table.column("block")[0].as_py()
        return pa.table([pa.array(there, pa.int32()), pa.array([block] * len(there), pa.int64()), pa.array(packed, pa.binary())], names=["shard", "block", "keys"])

    def answers(asked: pa.Table, shard: pa.Table) -> pa.Table:
        keys = asked.column("keys").to_pylist()
        held = ((s, b) for s, b in zip(shard.column("shard").to_pylist(), shard.column("bits").to_pylist()))
        found = Filter(shards, held, sum(map(len, shard.column("bits").to_pylist())))
        levels = [found.levels(np.frombuffer(k, np.uint64)).astype(np.uint8).tobytes() for k in keys]
        return pa.table([asked.column("block"), pa.array(keys, pa.binary()), pa.array(levels, pa.binary())], names=["block", "keys", "levels"])

    def scored_block(table: pa.Table, known: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(known.column("keys").to_pylist()), np.uint64)
        level = np.frombuffer(b"".join(known.column("levels").to_pylist()), np.uint8)
        order = np.argsort(keys)
        keys, level = keys[order], level[order].astype(np.int64)
        found = parts(table.column("text").to_pylist(), lambda asked: level[np.searchsorted(keys, asked)])
        return pa.table([table.column("doc_id"), *found], names=names)

    asked = blocks.groupBy("block").applyInArrow(probes, "shard int, block long, keys binary")
    held = model.table.select("shard", "bits").groupBy("shard")
    got = asked.groupBy("shard").cogroup(held).applyInArrow(answers, "block long, keys binary, levels binary")
    return blocks.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(scored_block, schema)
