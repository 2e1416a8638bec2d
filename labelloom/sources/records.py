"""Records of CSV files, with line breaks inside quotes, of files that are read block by block.

Whether a block begins inside quotes depends on everything before it. So each line is a small function:
from whether it begins inside quotes to whether it ends inside. Functions of lines compose to one for
each block, and a scan over the blocks of a file, one row each, tells how every block begins. Then the
lines of each block are gathered to records on their own; only a record cut by the end of a block is
put together from more than one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.operators.joins import broadcast_if_small
from labelloom.operators.positions import file_columns
from labelloom.staging import stage

# What may stand between quotes, by dialect: a quote is doubled, or has a backslash before it. All repetitions are
# possessive, so that very long values need neither stack nor second attempts.
_INSIDE = {"quoted": r'[^"]*+(?:""[^"]*+)*+', "escaped": r'[^"\\]*+(?:\\(?:.|\z)[^"\\]*+)*+'}
DIALECTS = (*_INSIDE, "unquoted")

_BLOCK = ("_file", "_block")


def _field(dialect: str) -> str:
    """A field that is closed. What follows a closing quote up to the comma belongs to the field, quotes and all."""
    return rf'(?:"{_INSIDE[dialect]}"[^,]*+|[^",][^,]*+|(?=,|\z))'


def _opens(line: Column, dialect: str) -> Column:
    """Whether a line that begins a record ends inside quotes."""
    return line.rlike(rf'(?s)\A(?:{_field(dialect)},)*+"{_INSIDE[dialect]}\z')


def _stays(line: Column, dialect: str) -> Column:
    """Whether a line that begins inside quotes ends inside quotes, the same or later ones."""
    inside = _INSIDE[dialect]
    return line.rlike(rf'(?s)\A{inside}(?:\z|"[^,]*+(?:,{_field(dialect)})*+,"{inside}\z)')


def fields(record: Column, dialect: str) -> Column:
    """The fields of a record as an array. An empty field is NULL, with or without quotes."""
    if dialect == "unquoted":
        return T.decode_unquoted(record)
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f"(?s),({_field(dialect)})"), F.lit(1))
    closed = rf'(?s)\A"{_INSIDE[dialect]}"\z'

    def value(f: Column) -> Column:
        inner = F.substring(f, F.lit(2), F.length(f) - 2)
        plain = F.replace(inner, F.lit('""'), F.lit('"')) if dialect == "quoted" else F.regexp_replace(inner, r'\\(["\\])', "$1")
        return F.nullif(F.when(F.startswith(f, F.lit('"')) & f.rlike(closed), plain).otherwise(f), F.lit(""))

    return F.transform(raw, value)


def _states(rows: DataFrame, window: WindowSpec, opens: str, stays: str) -> DataFrame:
    """Add ``_in0`` and ``_in1``: whether each row begins inside quotes if the first one begins outside, or inside.

    A row either keeps what was, turns it round, or decides it. So the state is that of the last row that decides, turned
    round by those since; without one, it is the first state turned round by all.
    """
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.col(opens) & ~F.col(stays)
    rows = rows.withColumn("_turned", F.coalesce(F.sum(turns.cast("long")).over(before), F.lit(0)))
    decides = F.when(F.col(opens) == F.col(stays), F.struct(F.col(opens).alias("inside"), F.col("_turned").alias("at")))
    rows = rows.withColumn("_decided", F.last(decides, ignorenulls=True).over(before))
    since = F.col("_turned") - F.col("_decided.at")
    for first in (0, 1):
        state = F.when(F.col("_decided").isNotNull(), F.col("_decided.inside").cast("long") + since).otherwise(F.col("_turned") + first)
        rows = rows.withColumn(f"_in{first}", state % 2 == 1)
    return rows.drop("_turned", "_decided")


def _ends(state: Column, opens: str, stays: str) -> Column:
    return F.when(state, F.col(stays)).otherwise(F.col(opens))


class Records:
    """The records of one or more files.

    The lines are written to the shared folder once, because how files are cut into blocks may differ between two
    evaluations. A record ends at a line feed, or a carriage return and a line feed, outside quotes; blank lines
    between records are none. Bytes that are not UTF-8 become U+FFFD. Quotes that are never closed make the rest of
    their file one record.
    """

    def __init__(self, spark: SparkSession, path: str, dialect: str, multi_line: bool = True, glob: str | None = None) -> None:
        """``multi_line=False`` says that there are no line breaks inside quotes, so that nothing has to be looked for."""
        if dialect not in DIALECTS:
            raise ValueError(f"dialect must be one of {DIALECTS}")
        self.dialect = dialect
        reader = spark.read.option("lineSep", "\n")
        lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
        lines = lines.select(F.make_valid_utf8("value").alias("value"), *[c.alias(n) for n, c in file_columns().items()])
        value, quoted = F.col("value"), multi_line and dialect != "unquoted"
        # a line without quotes keeps what was, and needs no pattern
        some = F.contains(value, F.lit('"'))
        flags = {
            "_opens": some & _opens(value, dialect) if quoted else F.lit(False),
            "_stays": ~some | _stays(value, dialect) if quoted else F.lit(True),
            "_blank": value.isin("", "\r"),
            "_row": F.monotonically_increasing_id(),
        }
        self.lines = stage(lines.withColumns(flags), "lines")
        odd = self.lines.agg(F.bool_or(F.col("_opens") | F.col("_blank"))).first()[0]
        #: whether every line is a record
        self.plain = not odd
        self.blocks = stage(self._placed(self._plain_blocks() if self.plain else self._blocks()), "blocks")

    def _plain_blocks(self) -> DataFrame:
        counts = self.lines.groupBy(*_BLOCK).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
        return counts.withColumns({"_inside": F.lit(False), "_after": F.lit(False)})

    def _blocks(self) -> DataFrame:
        """Per block: whether it begins and ends inside quotes and how many records begin in it."""
        window = Window.partitionBy(*_BLOCK).orderBy("_row")
        narrow = _states(self.lines.drop("value"), window, "_opens", "_stays")
        figures = [F.min("_row").alias("_first")]
        for first in (0, 1):
            state = F.col(f"_in{first}")
            figures.append(F.max_by(_ends(state, "_opens", "_stays"), "_row").alias(f"_after{first}"))
            figures.append(F.count_if(~state & ~F.col("_blank")).alias(f"_n{first}"))
        blocks = stage(narrow.groupBy(*_BLOCK).agg(*figures), "block-functions")
        scanned = _states(blocks, Window.partitionBy("_file").orderBy("_block"), "_after0", "_after1")
        begins = F.col("_in0")  # files begin outside quotes
        chosen = {name: F.when(begins, F.col(f"{name}1")).otherwise(F.col(f"{name}0")) for name in ("_n", "_after")}
        return scanned.select(*_BLOCK, "_first", begins.alias("_inside"), *[c.alias(n) for n, c in chosen.items()])

    @staticmethod
    def _placed(blocks: DataFrame) -> DataFrame:
        """Add the number of a block's first record in its file, and the place of the file's first row among all files, in
        order of folder, part number and name. The first record of a file is its header and has no place."""
        earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn("_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        files = blocks.groupBy("_file").agg(F.greatest(F.sum("_n") - 1, F.lit(0)).alias("_rows"))
        folder, part = F.regexp_replace("_file", "[^/]*$", ""), F.regexp_extract("_file", r"/part-(\d+)[^/]*$", 1).try_cast("long")
        above = Window.orderBy(folder, part, "_file").rowsBetween(Window.unboundedPreceding, -1)
        files = files.select("_file", F.coalesce(F.sum("_rows").over(above), F.lit(0)).alias("_place"))
        return blocks.join(files, "_file")

    def _gathered(self, blocks: DataFrame) -> DataFrame:
        """``_file, _place, number, record`` of all records that begin in these blocks, and ends of others."""
        lines = self.lines.join(broadcast_if_small(blocks), list(_BLOCK))
        if self.plain:
            number = F.col("_from") + F.col("_row") - F.col("_first")
            return lines.select("_file", "_place", number.alias("number"), F.regexp_replace("value", r"\r\z", "").alias("record"))
        window = Window.partitionBy(*_BLOCK).orderBy("_row")
        lines = _states(lines, window, "_opens", "_stays")
        lines = lines.withColumn("_in", F.when(F.col("_inside"), F.col("_in1")).otherwise(F.col("_in0")))
        begins = ~F.col("_in") & ~F.col("_blank")
        upto = window.rowsBetween(Window.unboundedPreceding, 0)
        lines = lines.withColumn("number", F.col("_from") - 1 + F.sum(begins.cast("long")).over(upto)).filter(F.col("_in") | begins)
        ended = ~_ends(F.col("_in"), "_opens", "_stays")
        value = F.when(ended, F.regexp_replace("value", r"\r\z", "")).otherwise(F.col("value"))
        cut = (F.col("number") < F.col("_from")) | (F.col("_after") & (F.col("number") == F.col("_from") + F.col("_n") - 1))
        parts = lines.groupBy(*_BLOCK, "_place", "number", cut.alias("_cut")).agg(_joined(F.struct("_row", value.alias("value"))).alias("record"))
        whole = parts.filter("not _cut").select("_file", "_place", "number", "record")
        pieces = parts.filter("_cut").groupBy("_file", "_place", "number").agg(_joined(F.struct("_block", F.col("record").alias("value"))).alias("record"))
        return whole.unionByName(pieces)

    def _read(self, gathered: DataFrame) -> DataFrame:
        name = F.regexp_extract("_file", "([^/]*)$", 1)
        return gathered.select("_file", name.alias("source_file"), "_place", "number", fields(F.col("record"), self.dialect).alias("fields"))

    def headers(self) -> DataFrame:
        """``_file, source_file, fields`` of the first record of every file; only the blocks that hold them are read."""
        first = self._gathered(self.blocks.filter("_from <= 1")).filter("number = 0")
        return self._read(first).select("_file", "source_file", "fields")

    def rows(self) -> DataFrame:
        """``_file, source_file, pos, fields`` of all records but the headers, ``pos`` counting from 0 over all files."""
        rows = self._read(self._gathered(self.blocks).filter("number > 0"))
        return rows.select("_file", "source_file", (F.col("_place") + F.col("number") - 1).alias("pos"), "fields")


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(parts)), lambda p: p["value"]), "\n")


def columns(names: Sequence[str]) -> list[Column]:
    """The first fields as columns, NULL where a record has fewer."""
    return [F.get("fields", F.lit(i)).alias(name) for i, name in enumerate(names)]
