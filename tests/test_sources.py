"""Files in, files out. Small files are written by hand to show each rule of the readers."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from labelloom import staging
from labelloom.operators import splits
from labelloom.plans import corpus
from labelloom.sources import csv, lines, sinks
from labelloom.sources.records import Records, columns

FILES = {"sentence": "sents.txt", "sentiment": "sentiments.txt"}


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_aligned_lines(spark, tmp_path):
    put(tmp_path / "train/sents.txt", " a \n\nb\n")
    put(tmp_path / "train/sentiments.txt", "0\n2\n\n")
    put(tmp_path / "val/sents.txt", "a\nb\nc")
    put(tmp_path / "val/sentiments.txt", "0\n1")
    put(tmp_path / "test/sents.txt", "a\n")
    rows, status = lines.read_aligned_lines(spark, str(tmp_path), FILES)
    assert sorted((r.split, r.pos, r.sentence, r.sentiment) for r in rows.collect()) == [
        ("train", 0, "a", "0"), ("train", 1, "b", "2"),
    ]
    assert {r.split: (r.status, r.least, r.most) for r in status.collect()} == {
        "train": ("ok", 2, 2), "val": ("count_mismatch", 2, 3), "test": ("missing_file", None, None),
    }


def test_aligned_lines_empty(spark, tmp_path):
    put(tmp_path / "train/sents.txt", "\n \n")
    put(tmp_path / "train/sentiments.txt", "\n")
    rows, status = lines.read_aligned_lines(spark, str(tmp_path), FILES, ["train"])
    assert rows.count() == 0
    assert [r.status for r in status.collect()] == ["empty"]


def test_aligned_lines_over_many_blocks(spark, tmp_path):
    """Files cut into many blocks of different sizes still pair up, as do folders of part files."""
    n = 20000
    put(tmp_path / "train/sents.txt", "\n".join(f"{'x' * (i % 37)} {i}" + "\n" * (i % 3) for i in range(n)))
    put(tmp_path / "train/sentiments.txt", "\n".join(str(i) for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        spark.range(n).repartitionByRange(6, "id").sortWithinPartitions("id").select(
            F.col("id").cast("string")
        ).write.text(str(tmp_path / "train/third"))
        files = {**FILES, "third": "third"}
        rows, status = lines.read_aligned_lines(spark, str(tmp_path), files, ["train"])
        bad = rows.filter(
            (F.substring_index("sentence", " ", -1) != F.col("sentiment"))
            | (F.col("sentiment") != F.col("third"))
            | (F.col("pos") != F.col("third").cast("int"))
        )
        assert (rows.count(), bad.count()) == (n, 0)
        assert status.first().status == "ok"
        assert lines.read_text(spark, str(tmp_path / "train/sents.txt")).select("_block").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_zip_tables_needs_equal_counts(spark):
    a = spark.range(4).withColumnRenamed("id", "a")
    b = spark.range(10, 14).select((-F.col("id")).alias("b"))
    assert sorted((r.a, r.b) for r in lines.zip_tables(a, b, ["a"], ["b"]).collect()) == [(0, -13), (1, -12), (2, -11), (3, -10)]
    assert lines.zip_tables(a, b.limit(3), ["a"], ["b"]).count() == 0


@pytest.mark.parametrize("multi_line", [True, False])
@pytest.mark.parametrize("dialect", ["escaped", "quoted"])
def test_lenient_csv(spark, tmp_path, multi_line, dialect):
    kept = ["a,1", '"b, c",2', '"d""e,",0' if dialect == "quoted" else '"d\\"e,",0', "only", '"on,ly"', "u,"]
    dropped = ["x,1,extra", "y,1,", "z,1,,", "x,,z", '"p, q",1,2']
    path = put(tmp_path / "in.csv", "\n".join(["h1,h2", *kept, *dropped]) + "\n")
    rows = csv.read_csv_lenient(spark, path, dialect, multi_line)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([
        ("a", "1"), ("b, c", "2"), ('d"e,', "0"), ("only", None), ("on,ly", None), ("u", None),
    ], key=str)
    assert rows.count() == 6
    assert rows.select("sentiment").filter("sentiment is null").count() == 3


def test_lenient_csv_with_line_breaks_and_long_texts(spark, tmp_path):
    text = "a, " * 50_000
    path = put(tmp_path / "in.csv", f'h1,h2\n"one\ntwo",1\n"{text}",2\n"{text}",2,3\n')
    rows = csv.read_csv_lenient(spark, path)
    assert sorted(map(tuple, rows.collect())) == [(text, "2"), ("one\ntwo", "1")]
    assert csv.read_csv_lenient(spark, str(tmp_path / "absent.csv")) is None


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_dir(spark, tmp_path, multi_line):
    put(tmp_path / "a.csv", "text,label,more\nx,negative,9\ny,odd,9\n")
    put(tmp_path / "b.csv", 'sentiment,sentence\n"z, z",positive\n')
    put(tmp_path / "c.csv", '"one, column"\nw\n')
    put(tmp_path / "d.txt", "p,q\nr,s\n")
    rows = csv.read_csv_dir(spark, str(tmp_path), multi_line=multi_line)
    assert sorted(map(tuple, rows.collect())) == [
        ("x", "negative", "a.csv"), ("y", "odd", "a.csv"), ("z, z", "positive", "b.csv"),
    ]
    cleaned = corpus.clean_sentences(rows, label_words=True)
    assert {(r.sentence, r.sentiment) for r in cleaned.collect()} == {("x", 0), ("y", None), ("z, z", 2)}
    assert dict(cleaned.dtypes)["sentiment"] == "int"


@pytest.mark.parametrize("multi_line", [True, False])
def test_raw_rows(spark, tmp_path, multi_line):
    content = b'text,label\nx,1,extra\nonly\n"on,ly"\nt,\n,2\n\xff\xfebad,oops\n"q ""q""",2\n'
    path = put(tmp_path / "train.csv", content)
    rows = csv.read_raw_rows(spark, path, multi_line=multi_line)
    assert sorted((r.pos, r.text, r.label) for r in rows.collect()) == [
        (0, "x", "1"), (3, "t", ""), (4, "", "2"), (5, "��bad", "oops"), (6, 'q "q"', "2"),
    ]
    final = corpus.final_corpus(rows.withColumn("split", F.lit("train"))).collect()
    assert {(r.id[:5], r["class"]) for r in final} == {("10000", 1), ("10003", 1), ("10004", 2), ("10005", 1), ("10006", 2)}


def test_raw_rows_positions_in_order(spark, tmp_path):
    path = put(tmp_path / "big.csv", "text,label\n" + "".join(f"row {i},{i % 3}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = csv.read_raw_rows(spark, path, multi_line=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(r.pos, r.text) for r in rows} == {(i, f"row {i}") for i in range(5000)}


def test_splits(spark, tmp_path):
    put(tmp_path / "train.csv", "id,text,class\n1A,\"a, b\",2\n")
    put(tmp_path / "val.csv", "text,class,id\nc,x,2B\n")
    with_test = tmp_path / "test.csv"
    rows = csv.read_splits(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [("train", "1A", "a, b", 2), ("val", "2B", "c", None)]
    assert rows.filter("split = 'test'").count() == 0
    put(with_test, "id,text\n3C,d\n")
    rows = csv.read_splits(spark, str(tmp_path))
    assert [tuple(r) for r in rows.filter("split = 'test'").collect()] == [("test", "3C", "d", 1)]
    assert dict(rows.dtypes)["class"] == "int"
    with pytest.raises(AnalysisException):
        csv.read_splits(spark, str(tmp_path / "absent"))


@pytest.fixture()
def awkward(spark):
    texts = ['say "hi", ok', " padded ", "two\nlines", "back\\slash", "", "plain", 'end"', "trailing\\"]
    return spark.createDataFrame([("train", t, i) for i, t in enumerate(texts)], "split string, sentence string, sentiment int")


def test_corpus_csv_round_trip(spark, tmp_path, awkward):
    sinks.write_corpus(awkward, str(tmp_path / "out"), "csv")
    back = csv.read_csv_dir(spark, str(tmp_path / "out/split=*"))
    got = {(r.sentence or "", int(r.sentiment)) for r in back.collect()}
    assert got == {(r.sentence, r.sentiment) for r in awkward.collect()}


def test_final_csv_layout(spark, tmp_path):
    df = spark.createDataFrame([("1ABC", 'a "b", c', 2), ("2ABC", "plain", 0)], "id string, text string, class int")
    sinks.write_final_csv(df.coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("*.csv")
    assert part.read_text() == 'id,text,class\n1ABC,"a ""b"", c",2\n2ABC,plain,0\n'


def test_unquoted_round_trip(spark, tmp_path, awkward):
    sinks.write_unquoted(awkward, str(tmp_path / "out"), "sentence", "sentiment")
    back = lines.read_unquoted(spark, str(tmp_path / "out"))
    assert {(r.sentence, int(r.sentiment)) for r in back.collect()} == {(r.sentence, r.sentiment) for r in awkward.collect()}
    put(tmp_path / "more.txt", "a,b,c\nonly\n")
    assert [tuple(r) for r in lines.read_unquoted(spark, str(tmp_path / "more.txt")).collect()] == [("only", None)]


def test_append_and_versions(spark, tmp_path):
    table = str(tmp_path / "table")
    sinks.append_with_header(spark.range(3), table)
    sinks.append_batches(spark.range(3, 5), table)
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [0, 1, 2, 3, 4]
    versions = str(tmp_path / "versions")
    sinks.rewrite_safely(spark.read.parquet(table), versions, 1)
    sinks.rewrite_safely(sinks.read_latest(spark, versions).filter("id > 2"), versions, 2)
    assert sorted(r.id for r in sinks.read_latest(spark, versions).collect()) == [3, 4]
    assert spark.read.parquet(f"{versions}/version=1").count() == 5
    with pytest.raises(AnalysisException):
        sinks.rewrite_safely(spark.range(1), versions, 2)


def test_staged_tables(spark):
    df = spark.createDataFrame([(1, None, "x")], "`a b` int, c string, d string")
    staged = staging.stage(df, "t")
    assert staged.schema == df.schema
    assert staged.collect() == df.collect()


def test_versions(spark, tmp_path):
    path = str(tmp_path / "versions")
    with pytest.raises(FileNotFoundError):
        sinks.read_latest(spark, path)
    sinks.rewrite_safely(spark.range(3), path, 1)
    put(tmp_path / "versions/version=2/part-00000.parquet", b"half written")
    assert sinks.read_latest(spark, path).count() == 3
    sinks.rewrite_safely(spark.range(0), path, 2)
    assert sinks.read_latest(spark, path).count() == 0
    put(tmp_path / "versions/version=1/part-00009.parquet", b"not read")
    assert sinks.read_latest(spark, path).count() == 0
    with pytest.raises(AnalysisException):
        sinks.rewrite_safely(spark.range(1), path, 2)


def test_lenient_reader_of_unquoted_lines(spark, tmp_path):
    put(tmp_path / "in/a.csv", "sentence,sentiment\na\\, b,2\nplain,1\nfew\nx,1,extra\n\\N,\\\\N\n")
    put(tmp_path / "in/b.csv", "sentence,sentiment\n  c ,\\N\n")
    rows = csv.read_csv_lenient(spark, str(tmp_path / "in"), "unquoted").collect()
    assert sorted(((r.sentence, r.sentiment) for r in rows), key=repr) == sorted(
        [("a, b", "2"), ("plain", "1"), ("few", None), (None, "\\N"), ("  c ", None)], key=repr
    )
    assert csv.read_csv_lenient(spark, str(tmp_path / "missing.csv"), "unquoted") is None


@pytest.fixture()
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def csv_text(rows, dialect):
    """Lines of rows of texts; what needs quotes has them, and some others have them too."""
    def field(value, k):
        if not (set(value) & set(',"\n\r')) and k % 3:
            return value
        value = value.replace('"', '""') if dialect == "quoted" else value.replace("\\", "\\\\").replace('"', '\\"')
        return f'"{value}"'

    return "".join(",".join(field(v, i + k) for k, v in enumerate(row)) + ("\r\n" if i % 5 == 0 else "\n") for i, row in enumerate(rows))


@pytest.mark.parametrize("dialect", ["quoted", "escaped"])
def test_records_across_blocks(spark, tmp_path, small_blocks, dialect):
    """Quoted line breaks, quotes at every place, blank lines and records much longer than a block."""
    rng = random.Random(6)
    rows = [["head", "label"]]
    for i in range(90):
        text = "".join(rng.choice('ab,"\n\n') for _ in range(rng.choice([0, 3, 9, 30, 300])))
        rows.append([text, f"{i}"] + (["more"] if i % 17 == 0 else []))
    written = csv_text(rows, dialect)
    path = put(tmp_path / "in.csv", written + "\n\n" + csv_text([["last", ""]], dialect))
    got = csv.read_csv_lenient(spark, path, dialect, positions=True)
    records = Records(spark, path, dialect)
    assert records.blocks.count() > 20 and not records.plain
    want = [(r[0], r[1], i) for i, r in enumerate([*rows[1:], ["last", ""]]) if len(r) == 2]
    assert sorted(((r.sentence or "", r.sentiment or "", r.pos) for r in got.collect()), key=lambda r: r[2]) == want
    split = splits.split_ordered(got, ["pos"])
    assert {r.pos for r in split.filter("split = 'train'").collect()} == {r[2] for r in want[: int(0.8 * len(want))]}


@pytest.mark.parametrize("dialect", ["quoted", "escaped"])
def test_blocks_do_not_change_what_is_read(spark, tmp_path, dialect):
    """Any characters at all: stray quotes, unclosed ones, backslashes; cut at every place and read as a whole."""
    rng = random.Random(11)
    for n in range(2):
        path = put(tmp_path / f"{n}.csv", "h,i\n" + "".join(rng.choice('ab,,""\n\n\\ \r') for _ in range(700)) + "\n")
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        whole = sorted((r.pos, r.fields) for r in Records(spark, path, dialect).rows().collect())
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
        cut = Records(spark, path, dialect)
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert cut.blocks.count() > 10
        assert sorted((r.pos, r.fields) for r in cut.rows().collect()) == whole
        assert [p for p, _ in whole] == list(range(len(whole)))


def test_fields_are_those_of_the_csv_reader(spark, tmp_path):
    """Records of one line with quotes and backslashes anywhere, against Spark's own reader."""
    rng = random.Random(12)
    for dialect, escape in (("quoted", '"'), ("escaped", "\\")):
        made = ["".join(rng.choice('ab"",, \\' if dialect == "escaped" else 'ab"",, ') for _ in range(rng.randint(1, 9))) for _ in range(400)]
        quoted = [m for m in made if csv_closed(m, dialect) and m.strip()]
        path = put(tmp_path / f"{dialect}.csv", "h,i\n" + "".join(f"{m}\n" for m in quoted))
        names = [f"c{i}" for i in range(10)]
        schema = ", ".join(f"{n} string" for n in names)
        theirs = spark.read.schema(schema).options(header=True, escape=escape).csv(path).collect()
        ours = Records(spark, path, dialect).rows().select("pos", *columns(names)).orderBy("pos").collect()
        assert [tuple(r) for r in theirs] == [tuple(r)[1:] for r in ours]


def csv_closed(line, dialect):
    """Whether every field that begins with a quote is plainly quoted; others, readers take in their own ways."""
    inside = r'(?:[^"]|"")*' if dialect == "quoted" else r'(?:[^"\\]|\\["\\])*'
    return re.fullmatch(rf'(?:"{inside}"|[^",][^,]*|)(?:,(?:"{inside}"|[^",][^,]*|))*', line) is not None


def test_positions_over_files_and_headers(spark, tmp_path, small_blocks):
    put(tmp_path / "b/part-00010-x.csv", "s,l\nlast,1\n")
    put(tmp_path / "b/part-00002-x.csv", '"s\n\n",l\n"one\ntwo",1\n\nthree,0\n')
    put(tmp_path / "b/part-00003-x.csv", "only one\nw\n")
    rows = csv.read_csv_dir(spark, str(tmp_path / "b"), positions=True).collect()
    assert sorted((r.pos, r.sentence, r.source_file) for r in rows) == [
        (0, "one\ntwo", "part-00002-x.csv"), (1, "three", "part-00002-x.csv"), (3, "last", "part-00010-x.csv"),
    ]
    put(tmp_path / "empty.csv", "")
    assert csv.read_csv_lenient(spark, str(tmp_path / "empty.csv")).count() == 0
