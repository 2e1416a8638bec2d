"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, whatever the length of
the text. Sketches therefore merge by union, and the part of a short document that a long one holds
can be estimated from the two sketches alone. The smallest hash is kept even if it is not below the
fraction, so that no text with a word has an empty sketch.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import id_and_text, rows_per_task, ship
from labelloom.llm.shingles import shingle_hashes

#: Words of a shingle, and the part of all hashes that is kept: one in SCALE.
WIDTH, SCALE = 5, 4
_BELOW = np.uint64(2**64 // SCALE)


def sketch(text: str) -> np.ndarray:
    """Sorted hashes kept of a text."""
    hashes = shingle_hashes(text, WIDTH)
    return hashes[: max(int(np.searchsorted(hashes, _BELOW)), min(1, len(hashes)))]


def written(hashes: np.ndarray) -> str:
    """A sketch as text: base64 of the sorted hashes, little-endian unsigned 64-bit. Empty for a text without words."""
    return base64.b64encode(hashes.astype("<u8").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    both = np.union1d(a, b)
    return both[: max(int(np.searchsorted(both, _BELOW)), min(1, len(both)))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller set's shingles that the other has, 0 to 1.

    Only hashes below the fraction can be compared; if one of the sketches has none, it is 1 for equal sketches, else 0.
    """
    low_a, low_b = a[a < _BELOW], b[b < _BELOW]
    least = min(len(low_a), len(low_b))
    if not least:
        return float(np.array_equal(a, b))
    return len(np.intersect1d(low_a, low_b, assume_unique=True)) / least


@F.arrow_udf(T.DoubleType())
def _likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([likeness(read(x.as_py() or ""), read(y.as_py() or "")) for x, y in zip(a, b)], pa.float64())


def compared(a: str | Column, b: str | Column) -> Column:
    """:func:`likeness` of two fingerprint columns."""
    return _likeness(a, b)


def _bucket(bounds: list, key: Column, kind: str) -> Column:
    """How many bounds lie below a key, looked up in two steps of about the square root of their number."""
    if not bounds:
        return F.when(key.isNull(), -1).otherwise(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    typed = lambda values: F.array(*[F.lit(v).cast(kind) for v in values])
    whole = F.size(F.filter(typed([p[-1] for p in parts]), lambda b: b < key))
    inside = F.element_at(F.array(*[typed(p) for p in parts]), F.least(whole, F.lit(len(parts) - 1)) + 1)
    found = whole * step + F.when(whole < len(parts), F.size(F.filter(inside, lambda b: b < key))).otherwise(0)
    return F.when(key.isNull(), -1).otherwise(F.least(found, F.lit(len(bounds)))).cast("int")


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """``doc_id, text, _bucket, _context`` dealt out and sorted so that each row is followed by the next document's.

    The order is falling ids, nulls last, and after the last comes the first. Ids are cut into buckets at quantiles; the
    first document of each bucket is also sent, as context, to the end of the bucket before it. So the texts are
    shuffled once, and no task holds more than a bucket, which it streams. Only a row per bucket reaches the driver.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    n = rows_per_task(spark)
    shares = [i / n for i in range(1, n)]
    cuts = rows.agg(F.percentile_approx("doc_id", shares, 100 * n)).first()[0] if shares else None
    bucketed = rows.withColumn("_bucket", _bucket(sorted(set(cuts or [])), F.col("doc_id"), kind))
    heads = sorted(bucketed.groupBy("_bucket").agg(F.max("doc_id")).collect(), reverse=True)
    # the head of each bucket goes to the one before it, that of the first to the last
    sent = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    table = spark.createDataFrame(sent, f"_head {kind}, _to int")
    joined = bucketed.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    places = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("c")), F.struct(F.col("_to").alias("b"), F.lit(True).alias("c")))
    dealt = joined.select("doc_id", "text", F.explode(F.filter(places, lambda p: p["b"].isNotNull())).alias("_p"))
    dealt = dealt.select("doc_id", "text", F.col("_p.b").alias("_bucket"), F.col("_p.c").alias("_context"))
    dealt = dealt.repartitionById(n, F.pmod("_bucket", F.lit(n)).cast("int"))
    order = [F.desc("_bucket"), F.asc("_context"), F.desc_nulls_last("doc_id"), F.asc("text")]
    return dealt.sortWithinPartitions(*order), n


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited form, and their likeness.

    Gives ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The edited text has
    its last third of code points replaced by as many from the start of the next document, or all it has. Null and empty
    texts have the empty fingerprint, which is like another empty one (1) and unlike all others (0). Rows with equal ids
    follow each other in the order of their texts; null ids come last. A single row is its own next document. Other
    columns are not read. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    dealt, _ = with_next(docs, id_col, text)
    kind = dealt.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = bucket = None
        for batch in batches:
            out: list[dict] = []
            for i in range(batch.num_rows):
                doc_id, value, here, context = (column[i].as_py() for column in batch.columns)
                if here != bucket:
                    waiting, bucket = None, here
                if context and waiting is None:
                    continue  # a further row with the same id
                own = sketch(value)
                if waiting is not None:
                    before, old, kept = waiting
                    cut = len(old) // 3
                    edited = old[: len(old) - cut] + value[:cut]
                    other = sketch(edited)
                    out.append(
                        {
                            "doc_id": before,
                            "n_chars": len(old),
                            "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
                            "fingerprint": written(kept),
                            "edited_fingerprint": written(other),
                            "near_edited": likeness(kept, other),
                            "near_next": likeness(kept, own),
                        }
                    )
                waiting = None if context else (doc_id, value, own)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema(
        [
            ("doc_id", _arrow_type(dealt)),
            ("n_chars", pa.int64()),
            *[(name, pa.string()) for name in ("edited_sha256", "fingerprint", "edited_fingerprint")],
            ("near_edited", pa.float64()),
            ("near_next", pa.float64()),
        ]
    )
    return dealt.mapInArrow(run, schema)


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["doc_id"].dataType)
