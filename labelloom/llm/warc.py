"""WARC archives with revisit records.

Headers alone (id, payload size and digest) are shuffled to find the original of each payload; a
record is then a response or a revisit that names its original. Archives are written by Spark's text
sink, so to any store that Spark writes to: WARC is text where payloads are, and the line separator
is what ends a record. They are read back record by record by ``Content-Length``, not by looking for
separators, so payloads may hold anything. What was read is resolved again: headers are shuffled by
payload digest and revisits joined to the responses they name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import ship
from labelloom.staging import new_path, stage

#: Payloads of fewer bytes are always stored. Archives hold about so many bytes of payload each.
LEAST_BYTES, ARCHIVE_BYTES = 1000, 16 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAK = "\r\n"


def _record_id(page: Column) -> Column:
    """A name-based id: the hash of the page's id and of the payload's digest in the form of a UUID."""
    h = F.md5(F.concat(F.lit("page:"), page.cast("string"), F.lit(":"), F.col("digest")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _one_line(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[\\r\\n]+", " ")


def with_roles(pages: DataFrame, archives: int) -> DataFrame:
    """Columns ``page_id, url, payload`` with ``n_bytes, digest`` and ``original``, the page a revisit refers to, else null.

    Rows are dealt by page id and payload to so many parts, which the join with the revisits keeps: payloads are shuffled
    once. A page id with several payloads has a role for each of them.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    headers = rows.filter(F.col("n_bytes") >= LEAST_BYTES).groupBy("digest", "n_bytes")
    shared = headers.agg(F.max("page_id").alias("original"), F.count("*").alias("_n")).filter("_n > 1")
    # only digests that occur again are joined, and to headers: payloads are met by these three later
    heads = rows.select("page_id", "digest", "n_bytes").filter(F.col("n_bytes") >= LEAST_BYTES)
    found = heads.join(shared.drop("_n"), ["digest", "n_bytes"]).filter("page_id <> original")
    each = ["page_id", "digest", "n_bytes"]
    return rows.repartition(archives, *each).join(found.select(*each, "original").distinct(), each, "left")


def records(roles: DataFrame) -> Column:
    """One record as text, up to the two line breaks that end it."""
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    revisit = F.col("original").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_BREAK))
    return F.concat(
        F.lit("WARC/1.1" + _BREAK),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", _one_line(F.col("url"))),
        line("WARC-Payload-Digest", digest),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("original"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit(_BREAK),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record per row of ``page_id, url, html``. Of payloads of at least ``LEAST_BYTES`` that are equal, the largest
    page id is stored and the others refer to it.

    Null payloads are empty; rows with a null page id are stored whole. Rows that repeat a page id with the stored payload
    are stored again; an id with several payloads has a record of its own for each. Other columns are ignored. An empty table gives an archive without records.
    """
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    archives = total // ARCHIVE_BYTES + 1
    roles = with_roles(pages, archives)
    roles.select(records(roles).alias("value")).write.option("lineSep", _BREAK * 2).option("compression", "gzip").text(path)


def parsed(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payloads of the records in a stream of bytes."""
    held = bytearray()

    def upto(n: int) -> bool:
        while len(held) < n:
            block = next(blocks, None)
            if block is None:
                return False
            held.extend(block)
        return True

    end = (_BREAK * 2).encode()
    while True:
        seen = 0
        while (at := held.find(end, max(0, seen - 3))) < 0:
            seen = len(held)
            if not upto(seen + 1):
                if held.strip():
                    raise ValueError("an archive ends inside a record's header")
                return
        head = bytes(held[:at]).decode().split(_BREAK)
        if not head[0].startswith("WARC/"):
            raise ValueError("no record where one should begin")
        fields = dict(line.split(": ", 1) for line in head[1:])
        length = int(fields["Content-Length"])
        if not upto(at + 4 + length + 4) or bytes(held[at + 4 + length : at + 8 + length]) != end:
            raise ValueError("an archive ends inside a record")
        yield fields, bytes(held[at + 4 : at + 4 + length])
        del held[: at + 8 + length]


def _inflated(packed: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, piece by piece."""
    while packed:
        unzip = zlib.decompressobj(31)
        rest = packed
        while rest and not unzip.eof:
            yield unzip.decompress(rest, step)
            rest = unzip.unconsumed_tail
        yield unzip.flush()
        if not unzip.eof:
            raise ValueError("an archive ends inside a gzip member")
        packed = unzip.unused_data


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, record_type, url, page_id, digest, refers_to, n_bytes, payload`` of every record below ``path``.

    A response whose payload does not have the digest its header states is an error.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    names = ["record_id", "record_type", "url", "page_id", "digest", "refers_to", "n_bytes", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for fields, payload in parsed(_inflated(content.as_py())):
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                    page = int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None
                    rows.append((fields["WARC-Record-ID"], kind, fields["WARC-Target-URI"], page, digest, fields.get("WARC-Refers-To"), len(payload), payload))
                    size += len(payload)
                    if size > (4 << 20):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = "record_id string, record_type string, url string, page_id long, digest string, refers_to string, n_bytes long, payload binary"
    return files.mapInArrow(run, schema)


def resolved(found: DataFrame) -> DataFrame:
    """Each record with ``original``, ``payload_bytes`` and ``payload_digest`` of the payload it stands for.

    Headers are shuffled by digest; a revisit takes its size from the response it names. One that names none is an error
    in the archive and gets nulls.
    """
    headers = stage(found.select("record_id", "record_type", "page_id", "digest", "refers_to", "n_bytes"), "headers")
    revisits = headers.filter("record_type = 'revisit'")
    # a page id repeated with the same payload gives equal responses, hence the distinct
    named = headers.filter("record_type = 'response'").select(
        "digest", F.col("record_id").alias("refers_to"), F.col("page_id").alias("original"), F.col("n_bytes").alias("size")
    )
    named = named.join(revisits.select("digest", "refers_to").distinct(), ["digest", "refers_to"], "left_semi").distinct()
    joined = revisits.join(named, ["digest", "refers_to"], "left")
    columns = ["record_id", "page_id", "record_type", F.col("digest").alias("payload_digest")]
    return joined.select(*columns, "original", F.col("size").alias("payload_bytes")).unionByName(
        headers.filter("record_type <> 'revisit'").select(*columns, F.lit(None).cast("long").alias("original"), F.col("n_bytes").alias("payload_bytes"))
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write archives of ``pages`` below the shared folder, read them back and resolve their revisits."""
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return resolved(read_archives(spark, path))


def oracle_sql() -> str:
    """DuckDB SQL for the digest of :func:`round_trip` over ``pages``."""
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> original THEN original END AS refers_to FROM o
"""
