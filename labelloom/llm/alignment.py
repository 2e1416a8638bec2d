"""Alignment of the tokens that two tokenizers make of one text.

Both token sequences spell the same bytes. Where a token of each ends at the same byte, a group ends.
Most groups are one token against one, so the arrays of token ends are equal over long stretches once
one of them is shifted: at the current shift, spans of 4, 8, 16, ... ends are compared as wholes, and
halved again where they differ. At the first difference an irregular group is walked token by token to
the next common end, which gives the new shift.

Inside a group every step of such a walk is one pair of tokens that share bytes, a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import lookup
from labelloom.llm.bpe import slices
from labelloom.llm.common import id_and_text, ship
from labelloom.llm.tokens import encoder
from labelloom.operators.joins import broadcast_if_small
from labelloom.staging import stage

#: Names of the two vocabularies in the folder of public tokenizers.
BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A pair of ids as one number: the first id times this plus the second. The second vocabulary must be smaller.
PAIR_BASE = 1 << 20
#: Links counted together in a task before they are handed on.
SLICE_LINKS = 2_000_000

#: Ends compared first at a new shift.
FIRST_STEP = 4

#: Whether it is a run of groups of one token against one, or else a single group; first and last place + 1 in both.
Stretch = tuple[bool, int, int, int, int]


def stretches(ends_a: list[int], ends_b: list[int]) -> Iterator[Stretch]:
    """Both sequences from begin to end. Ends rise strictly and the last ones are equal."""
    i = j = 0
    n, m = len(ends_a), len(ends_b)
    while i < n:
        first_i, first_j, step = i, j, min(FIRST_STEP, n - i, m - j)
        while step and ends_a[i : i + step] == ends_b[j : j + step]:
            i, j = i + step, j + step
            step = min(2 * step, n - i, m - j)
        while step > 1:
            step //= 2
            if ends_a[i : i + step] == ends_b[j : j + step]:
                i, j = i + step, j + step
        if i > first_i:
            yield True, first_i, i, first_j, j
        if i == n:
            return
        first_i, first_j = i, j
        x, y = ends_a[i], ends_b[j]
        while x != y:
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        i, j = i + 1, j + 1
        yield False, first_i, i, first_j, j


def links(ends_a: list[int], ends_b: list[int], a: int, to_a: int, b: int, to_b: int) -> tuple[list[int], list[int]]:
    """Places in both sequences of tokens that share bytes inside one group."""
    if to_a - a == 1:
        return [a] * (to_b - b), list(range(b, to_b))
    if to_b - b == 1:
        return list(range(a, to_a)), [b] * (to_a - a)
    at_a, at_b = [a], [b]
    while a < to_a - 1 or b < to_b - 1:
        if ends_a[a] < ends_b[b]:
            a += 1
        else:
            b += 1
        at_a.append(a)
        at_b.append(b)
    return at_a, at_b


class Pair:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece

        self.coder = encoder(byte_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.sizes_a = self.coder.sizes
        spelled = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            spelled.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes_b = spelled
        self.sizes_b = np.array([len(x) for x in spelled])
        if len(spelled) >= PAIR_BASE:
            raise ValueError("the second vocabulary is too large")
        self.names_a = [str(i) for i in range(len(self.sizes_a))]
        self.names_b = [str(i) for i in range(len(spelled))]
        self.ends_b = [f"|{i};" for i in range(len(spelled))]

    def align(self, text: str) -> tuple[np.ndarray, list[int], list[int], list[int]]:
        """Ids of a space and the text by the first tokenizer, and of the text by the second, which adds the space
        itself, and where their tokens end. All are empty for an empty text, and where either spells other bytes."""
        if text and "▁" not in text:  # that sign stands for a space in pieces
            a, b = self.coder.plain_ids(" " + text), self.pieces.encode(text)
            # byte-level ids always spell their text, so only the second has to be compared
            if b"".join(map(self.bytes_b.__getitem__, b)) == b" " + text.encode():
                return a, b, np.cumsum(self.sizes_a[a]).tolist(), np.cumsum(self.sizes_b[b]).tolist()
        return np.empty(0, np.uint32), [], [], []

    def linked(self, text: str) -> tuple[int, int, int, str, np.ndarray]:
        """Numbers of tokens of both and of groups, the groups' digest, and each link as a pair of ids."""
        a, b, ends_a, ends_b = self.align(text)
        if not b:
            return 0, 0, 0, "", np.empty(0, np.int64)
        said, at_a, at_b, run_a, run_b, sizes = [], [], [], [], [], []
        say_a, end_b = list(map(self.names_a.__getitem__, a.tolist())), list(map(self.ends_b.__getitem__, b))
        for run, i, to_i, j, to_j in stretches(ends_a, ends_b):
            if run:
                part = say_a[i:to_i] * 2
                part[::2], part[1::2] = say_a[i:to_i], end_b[j:to_j]
                said.extend(part)
                run_a.append(i)
                run_b.append(j)
                sizes.append(to_i - i)
            else:
                said.append(f"{','.join(say_a[i:to_i])}|{','.join([self.names_b[x] for x in b[j:to_j]])};")
                x, y = links(ends_a, ends_b, i, to_i, j, to_j)
                at_a.extend(x)
                at_b.extend(y)
        size = np.array(sizes, np.int64)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)  # places in runs
        at_a = np.append(np.repeat(np.array(run_a, np.int64), size) + inside, np.array(at_a, np.int64))
        at_b = np.append(np.repeat(np.array(run_b, np.int64), size) + inside, np.array(at_b, np.int64))
        pairs = a.astype(np.int64)[at_a] * PAIR_BASE + np.array(b, np.int64)[at_b]
        text = "".join(said)[:-1]
        return len(a), len(b), text.count(";") + 1, hashlib.sha256(text.encode()).hexdigest(), pairs


_pairs: dict[tuple[str, str], Pair] = {}


def pair(byte_path: str, piece_path: str) -> Pair:
    """This process's tokenizers."""
    key = byte_path, piece_path
    if key not in _pairs:
        _pairs[key] = Pair(*key)
    return _pairs[key]


def aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, a_ids, b_ids, groups``: the tokens of each whole text and its groups ``a_from, a_to, b_from, b_to``, places
    in the two arrays, ends exclusive.

    Texts that are null or empty, or that either tokenizer spells with other bytes, have empty arrays. Repeated rows give
    repeated results, null ids stay null, other columns are not read. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    rows = id_and_text(docs, id_col, text)
    names = ["a_from", "a_to", "b_from", "b_to"]
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(byte_path, piece_path)
        for batch in batches:
            for part, texts in slices(batch, 1):
                out: list[list] = [[], [], []]
                for value in texts:
                    a, b, ends_a, ends_b = both.align(value)
                    found = []
                    for one_to_one, i, to_i, j, to_j in stretches(ends_a, ends_b):
                        single = [(i + k, i + k + 1, j + k, j + k + 1) for k in range(to_i - i)]
                        found.extend(single if one_to_one else [(i, to_i, j, to_j)])
                    for column, values in zip(out, (a.tolist(), b, [dict(zip(names, g)) for g in found])):
                        column.append(values)
                arrays = [pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], kind)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", "a_ids", "b_ids", "groups"])

    fields = ",".join(f"{n}:int" for n in names)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, a_ids array<int>, b_ids array<int>, groups array<struct<{fields}>>")


def _found(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """A row per document: counts, the digest, and its distinct pairs with how often each is linked, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(byte_path, piece_path)
        for batch in batches:
            for part, texts in slices(batch, 1):
                counts, digests, pairs, times = [], [], [], []
                for value in texts:
                    n_a, n_b, n_groups, digest, found = both.linked(value)
                    counts.append((n_a, n_b, n_groups, len(found)))
                    digests.append(digest)
                    distinct, often = np.unique(found, return_counts=True)
                    pairs.append(distinct.tobytes())
                    times.append(often.astype(np.int32).tobytes())
                columns = [pa.array(np.array(c, np.int64)) for c in zip(*counts)]
                arrays = [part.column(0), *columns, pa.array(digests, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *COUNTS, "groups_sha256", "pairs", "times"])

    counts = ", ".join(f"{n} long" for n in COUNTS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, {counts}, groups_sha256 string, pairs binary, times binary")


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _packed(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _pair_counts(found: DataFrame) -> DataFrame:
    """``key, n``: how many documents hold a pair. Tasks add up their own documents before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def added() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])

        for batch in batches:
            held.append(_packed(batch.column(0), np.int64))
            if sum(map(len, held)) > SLICE_LINKS:
                yield added()
        if held:
            yield added()

    return found.select("pairs").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def linked(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every whole text.

    A link is a pair of tokens that share bytes; the count of its pair of ids is the number of rows that hold such a link.
    ``count_sum`` adds up the counts of a row's links, ``n_best`` counts those whose count is the highest of all pairs with
    the same first id. Texts that are null or empty, or that either tokenizer spells with other bytes, have zeros and an
    empty digest. Repeated rows count and give results as often as they occur, null ids stay null, other columns are not
    read. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    found = lookup.numbered(_found(id_and_text(docs, id_col, text), byte_path, piece_path), "alignments")
    counts = stage(_pair_counts(found), "pair-counts").withColumn("a", F.expr(f"key div {PAIR_BASE}"))
    most = broadcast_if_small(counts.groupBy("a").agg(F.max("n").alias("most")))  # as many rows as ids
    table = stage(counts.join(most, "a").select("key", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pair-table")
    sent = docs.sparkSession.sparkContext.broadcast(lookup.head_of(table, ["best", "n"], "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = sent.value
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column(1).to_pylist()], np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            sums, rest = head.split(_packed(batch.column(1), np.int64), _packed(batch.column(2), np.int32), row, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), rest], names=["_row", "n_best", "count_sum", "_rest"])

    looked = stage(found.select("_row", "pairs", "times").mapInArrow(run, f"_row long, n_best long, count_sum long, _rest {lookup.REST}"), "looked-up")
    sums = lookup.with_rest(looked, table.withColumnsRenamed({"best": "n_best", "n": "count_sum"}), ["n_best", "count_sum"])
    return found.drop("pairs", "times").join(sums, "_row").select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")
