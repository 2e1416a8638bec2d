"""Periodic runs of words: stretches in which the same few words follow each other again and again.

Runs are found from squares, two equal neighbouring stretches. An enhanced suffix array of the words
(order of suffixes, their ranks, and the lengths of common beginnings of neighbours) stands for the
suffix tree; no node is made. Each interval of suffixes with a common beginning of exactly ``depth``
words has children, parts with longer common beginnings. A suffix ``i`` of one child and ``i + depth`` of
another are a square that the next word does not continue, so only the suffixes of all children but
the largest are tested, whether ``i + depth`` or ``i - depth`` is in the interval too, by its rank. That
is n log n tests. A square is then rotated to the left as long as the words allow, which gives the whole
run; squares of the run's longer periods end at the same word and merge into it.

Texts of about ``SLICE`` characters share one suffix array: words are numbered apart in each text, so
that nothing is common to two of them. A longer text has one of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.bpe import slices
from labelloom.llm.common import id_and_text, ship

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Characters that share a suffix array.
SLICE = 2_000_000
#: Words compared at once when a square is rotated.
STEP = 64


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words, equal only for equal words of one text, and where texts begin. Each text is followed by a number
    of its own, smaller than those of its words."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(words) + 1 for words in texts], out=starts[1:])
    out = np.empty(starts[-1], np.int64)
    used = 0
    for words, start in zip(texts, starts.tolist()):
        number: dict[bytes, int] = {}
        place = number.setdefault
        out[start : start + len(words)] = [place(w, len(number) + used + 1) for w in words]
        out[start + len(words)] = used
        used += len(number) + 1
    return out, starts


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the rank of each, by doubling; only suffixes not yet told apart are sorted again.

    The last code occurs once.
    """
    n = len(codes)
    suffixes = np.argsort(codes, kind="stable")
    ordered = codes[suffixes]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[suffixes] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    width = 1
    slot = np.flatnonzero(~new | np.append(~new[1:], False))  # places of suffixes that share a rank
    while len(slot):
        own = suffixes[slot]
        # equal suffixes end before their text does, so the place looked at is inside
        key = rank[own] * n + rank[np.minimum(own + width, n - 1)]
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        suffixes[slot] = own
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[own] = slot[np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))]
        slot = slot[~first | np.append(~first[1:], False)]
        width *= 2
    return suffixes, rank


def common_lengths(codes: np.ndarray, suffixes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """By place in order: how many codes a suffix shares with the one before it; 0 for the first.

    In order of the text that number falls by one at most from each suffix to the next (Kasai et al. 2001).
    """
    before = np.empty(len(codes), np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    before[suffixes[0]] = -1
    shares = codes == codes[before]
    shares[suffixes[0]] = False
    where = np.flatnonzero(shares)
    word = codes.tolist()
    found, length, last = [], 0, -2
    for i, j in zip(where.tolist(), before[where].tolist()):
        length = length - 1 if i == last + 1 and length > 1 else 1
        while word[i + length] == word[j + length]:
            length += 1
        found.append(length)
        last = i
    out = np.zeros(len(codes), np.int64)
    out[rank[where]] = found
    return out


def intervals(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places whose suffix shares something with the one before it; for each of them the first place, and the last
    one plus 1, of the interval of suffixes that share as much.

    These are the nearest places before and after it with a smaller length.
    """
    where = np.flatnonzero(common)
    places, lengths = where.tolist(), common[where].tolist()
    left, right = [0] * len(places), [0] * len(places)
    stack: list[int] = []  # places, as numbers, with lengths that do not fall
    last = base = -2
    for k, (at, length) in enumerate(zip(places, lengths)):
        if at != last + 1:
            for k_open in stack:
                right[k_open] = last + 1
            stack.clear()
            base = at - 1
        while stack and lengths[stack[-1]] > length:
            right[stack.pop()] = at
        if not stack:
            left[k] = base
        elif lengths[stack[-1]] == length:
            left[k] = left[stack[-1]]
        else:
            left[k] = places[stack[-1]]
        stack.append(k)
        last = at
    for k_open in stack:
        right[k_open] = last + 1
    return where, np.array(left, np.int64), np.array(right, np.int64)


class Children:
    """The children of all intervals but the largest of each: first place, last place plus 1, and their interval."""

    def __init__(self, common: np.ndarray) -> None:
        where, left, right = intervals(common)
        order = np.lexsort((where, right, left))
        where, left, right = where[order], left[order], right[order]
        new = np.ones(len(where), bool)
        new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        group = np.cumsum(new) - 1
        self.left, self.right, self.depth = left[new], right[new], common[where[new]]
        # every interval begins with a child of its own, and every place inside it at its depth begins another
        begin = np.concatenate([self.left, where])
        owner = np.concatenate([np.arange(len(self.left)), group])
        order = np.lexsort((begin, owner))
        begin, owner = begin[order], owner[order]
        first = np.searchsorted(owner, np.arange(len(self.left)))
        end = np.roll(begin, -1)
        end[np.append(first[1:], len(owner))[: len(first)] - 1] = self.right
        largest = np.lexsort((begin - end, owner))[first]
        rest = np.ones(len(begin), bool)
        rest[largest] = False
        self.begin, self.end, self.owner = begin[rest], end[rest], owner[rest]

    def squares(self, suffixes: np.ndarray, rank: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and half lengths of squares that the next code does not continue, some of them twice."""
        upto = np.cumsum(self.end - self.begin)
        total, n = int(upto[-1]) if len(upto) else 0, len(suffixes)
        for low in range(0, total, most):
            number = np.arange(low, min(low + most, total))
            child = np.searchsorted(upto, number, "right")
            owner = self.owner[child]
            own = suffixes[self.end[child] - upto[child] + number]
            depth = self.depth[owner]
            for first, other in ((own, own + depth), (own - depth, own - depth)):
                inside = (other >= 0) & (other < n)
                place = rank[np.where(inside, other, 0)]
                inside &= (place >= self.left[owner]) & (place < self.right[owner])
                inside &= (place < self.begin[child]) | (place >= self.end[child])
                yield first[inside], depth[inside]


def _rotated(codes: np.ndarray, start: int, period: int) -> int:
    """How far to the left a square at ``start`` can be moved."""
    step = STEP
    while start:
        low = max(0, start - step)
        other = np.flatnonzero(codes[low:start] != codes[low + period : start + period])
        if len(other):
            return low + int(other[-1]) + 1
        start, step = low, 2 * step
    return start


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs, by start and period. The last code occurs once."""
    suffixes, rank = suffix_array(codes)
    children = Children(common_lengths(codes, suffixes, rank))
    found: set[tuple[int, int]] = set()  # end and period
    for start, period in children.squares(suffixes, rank):
        # the run must reach so far to the left: look at the ends of that stretch before all of it
        needed = np.maximum(LEAST_WORDS - 2 * period, (LEAST_PERIODS - 2) * period)
        far = start >= needed
        start, period, needed = start[far], period[far], needed[far]
        far = (codes[start - needed] == codes[start - needed + period]) & (codes[start - 1] == codes[start - 1 + period])
        found.update(zip((start[far] + 2 * period[far]).tolist(), period[far].tolist()))
    out: list[tuple[int, int, int]] = []
    here, reaching = -1, 0  # the end looked at, and how far the runs with this end reach to the left
    for end, period in sorted(found):
        start = end - 2 * period
        if end != here:
            here, reaching = end, end
        if start >= reaching:
            continue  # a square of several periods of a run found already
        start = _rotated(codes, start, period)
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * period):
            out.append((start, end - start, period))
            reaching = min(reaching, start)
    return sorted(out, key=lambda run: (run[0], run[2]))


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, given as words; places are words from 0."""
    codes, starts = numbered(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    found = find_runs(codes)
    owners = np.searchsorted(starts, [run[0] for run in found], "right") - 1
    for owner, (start, length, period) in zip(owners.tolist(), found):
        out[owner].append((start - int(starts[owner]), length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those past the first period of a run, joined by spaces."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def scanned(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every whole text.

    Words stand between ASCII white space (0x20, 0x09-0x0D). A run ``start, length, period`` is a stretch of words that
    equal those ``period`` before, with the smallest such period, of at least ``LEAST_WORDS`` words and
    ``LEAST_PERIODS`` periods, that no neighbouring word continues; runs are sorted by start, then period. ``collapsed``
    has of every run only its first period. Null and empty texts have no words, no runs and an empty result. Repeated
    rows give repeated results, null ids stay null, other columns are not read. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    rows = id_and_text(docs, id_col, text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1, SLICE):
                words = [value.encode().split() for value in texts]
                found = runs_of(words)
                arrays = [
                    part.column(0),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], kind),
                    pa.array([collapsed(w, r).decode() for w, r in zip(words, found)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "collapsed"])

    id_kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text`` with a period put into every text whose id's checksum is divisible by 10; its words are then
    joined by spaces. A null id has no checksum."""
    rows = id_and_text(docs, id_col, text).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    # ends are free of white space before the split, so there is no empty word
    words = F.split(F.regexp_replace("text", r"^[ \t-\r]+|[ \t-\r]+$", ""), r"[ \t-\r]+")
    rows = rows.withColumn("w", F.when((F.col("h") % 10 == 0) & F.col("text").rlike(r"[^ \t-\r]"), words))
    return rows.select("doc_id", F.expr(PLANTED).alias("text"))


#: a: first word of the period, p: its length
PLANTED = """CASE WHEN w IS NULL THEN text ELSE
  array_join(transform(array(named_struct('a', CAST((h div 10) % size(w) AS INT), 'k', CAST(3 + (h div 10) % 8 AS INT))),
    x -> array_join(transform(w, (v, i) -> CASE WHEN i < x.a THEN v ELSE
      w[x.a + (i - x.a) % (1 + (size(w) - x.a) div x.k)] END), ' ')), '') END"""


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the run with the most periods, and checksums of the runs and of the collapsed text."""
    # fractions are compared exactly, by cross products; of equal ones the first in order stays
    best = F.expr("aggregate(runs, CAST(NULL AS STRUCT<start:BIGINT,length:BIGINT,period:BIGINT>), (b, r) -> "
                  "CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = docs.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.array_join(lines, "").alias("said"))
    return rows.select(
        "doc_id",
        "n_runs",
        F.col("b.start").alias("start"),
        F.col("b.length").alias("length"),
        F.col("b.period").alias("period"),
        F.expr("(1000 * b.length) div b.period").alias("exponent_milli"),
        F.sha2("said", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
