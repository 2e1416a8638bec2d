"""Token counts of fields or sections, from one encoding of the whole document.

A document is encoded once. The byte lengths of its tokens give their character spans, which are
joined with the spans of its sections. A token inside one section counts there; one that crosses a
boundary is allocated by a rule. So the counts of a document's sections, with what lies outside
them, always add up to its own tokens, which counts of separately encoded sections do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import ship, whole_text
from labelloom.llm.tokens import encoder

#: Where a token goes that touches several sections: the one with its first character in any, with its last, or with most
#: of its characters (of equal ones the first).
RULES = ("first", "last", "most")


def line_spans(text: str) -> np.ndarray:
    """Sections ``start, end``: the lines of a text, without the line breaks, empty lines included; the empty text is one."""
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)
    return np.stack([np.append(0, breaks + 1), np.append(breaks, len(text))], 1)


def lines(text: Column) -> Column:
    """The same as an array of sections, null for a null text; in time that is linear in the text."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(texts: pa.Array) -> pa.Array:
        found = [None if t is None else [{"start": a, "end": b} for a, b in line_spans(t).tolist()] for t in texts.to_pylist()]
        return pa.array(found, kind)

    return F.arrow_udf(run, "array<struct<start:int,end:int>>")(text)


def character_spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of tokens in code points. A token that holds part of a character's bytes spans all of the character."""
    stops = np.cumsum(sizes[ids])
    starts = stops - sizes[ids]
    spelled = text.encode()
    if len(spelled) == len(text):
        return starts, stops
    place = np.cumsum((np.frombuffer(spelled, np.uint8) & 0xC0) != 0x80)  # by byte: its character, from 1
    return place[starts] - 1, place[stops - 1]


def allocate(starts: np.ndarray, stops: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens by section, the last entry counting those in none. ``sections``: sorted, not overlapping ``start, end``."""
    n = len(sections)
    found = np.zeros(n + 1, np.int64)
    begin, end = sections[:, 0], sections[:, 1]
    low = np.searchsorted(end, starts, "right")  # the first section that ends past the token's start
    high = np.searchsorted(begin, stops, "left") - 1  # the last that begins before its end
    found[n] = int((high < low).sum())
    chosen = np.where(rule == "last", high, low)
    several = np.flatnonzero(high > low)
    if rule == "most":
        for i in several.tolist():
            span = slice(low[i], high[i] + 1)
            chosen[i] = low[i] + int(np.argmax(np.minimum(end[span], stops[i]) - np.maximum(begin[span], starts[i])))
    np.add.at(found, chosen[high >= low], 1)
    return found


def counted(
    docs: DataFrame, sections: Column | None, path: str, rule: str = "most", id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, section, start, end, n_tokens``: a row per section of every whole text, and one with section -1 and null
    places for tokens in none, if there are any.

    ``sections`` is an array of structs ``start, end`` in code points, end exclusive, sorted and not overlapping (else an
    error); an empty section takes no tokens; null means no sections. No column at all (None) means the lines of each
    text, see :func:`line_spans`. Null and empty texts have no tokens. Repeated rows
    give repeated results. Other columns are read only by ``sections``. An empty table gives an empty table.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)
    kind = "array<struct<start:int,end:int>>"
    places = F.lit(None).cast(kind) if sections is None else F.transform(sections, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    rows = docs.select(docs[id_col].alias("doc_id"), whole_text(docs, text).alias("text"), places.alias("sections"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    by_line = sections is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            row: list[int] = []
            parts: list[np.ndarray] = []
            for i in range(batch.num_rows):
                value, spans = batch.column(1)[i].as_py(), batch.column(2)[i]
                own = spans.values if spans.is_valid else None
                table = line_spans(value) if by_line else np.empty((0, 2), np.int64)
                if own is not None and len(own):
                    table = np.stack([own.field(0).to_numpy(False), own.field(1).to_numpy(False)], 1).astype(np.int64)
                    if (table[1:, 0] < table[:-1, 1]).any() or (table[:, 0] > table[:, 1]).any():
                        raise ValueError("sections must be sorted and must not overlap")
                starts, stops = character_spans(value, coder.ids(value), coder.sizes)
                filled = np.flatnonzero(table[:, 1] > table[:, 0])
                tokens = np.zeros(len(table) + 1, np.int64)
                tokens[np.append(filled, len(table))] = allocate(starts, stops, table[filled], rule)
                out = np.column_stack([np.append(np.arange(len(table)), -1), np.append(table, [[-1, -1]], 0), tokens])
                out = out if tokens[-1] else out[:-1]
                parts.append(out)
                row.extend([i] * len(out))
            found = np.concatenate(parts) if parts else np.empty((0, 4), np.int64)
            outside = found[:, 0] < 0
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())),
                pa.array(found[:, 0], pa.int32()),
                pa.array(found[:, 1], pa.int64(), mask=outside),
                pa.array(found[:, 2], pa.int64(), mask=outside),
                pa.array(found[:, 3], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "section", "start", "end", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, section int, start long, end long, n_tokens long")
