"""Column functions on text."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelloom.functions import text as T


def values(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_strip_and_collapse(spark):
    texts = ["  a b \t", " 　x \x1c", "\x1f\x85 y ", "", None]
    assert values(spark, texts, T.strip_text("t")) == ["a b", "x", "y", "", None]
    texts = [" a  b\tc\n", " a　\x1cb", " \n "]
    assert values(spark, texts, T.collapse_whitespace("t")) == ["a b c", "a b", ""]


def test_remove_quotes_and_answers(spark):
    assert values(spark, ['"a" b"'], T.remove_quotes("t")) == ["a b"]
    assert values(spark, [' "hi" ', '" hi "'], T.clean_answer("t")) == ["hi", " hi "]


def test_last_comma(spark):
    lines = ["a,b,2", ",2", "a,", "é,ö, 2\r"]
    assert values(spark, lines, T.before_last_comma("t")) == ["a,b", "", "a", "é,ö"]
    assert values(spark, lines, T.after_last_comma("t")) == ["2", "2", "", " 2\r"]


def test_length_gate_counts_characters(spark):
    texts = ["x" * n for n in (49, 50, 100, 101)] + ["ế" * 50]
    assert values(spark, texts, T.has_sentence_length("t")) == [False, True, True, False, True]


def test_request_text(spark):
    got = values(spark, ["Hay lắm", None], T.paraphrase_request("t", F.lit("tích cực")))
    assert got[0].startswith("Dưới đây là một câu biểu thị cảm xúc tích cực. ")
    assert got[0].endswith('\nCâu gốc: "Hay lắm"\nCâu viết lại:')
    assert got[1] is None


def test_category_key(spark):
    assert values(spark, ["vui"], T.category_key("t", F.lit(2))) == ["vui_2"]


def test_tokens(spark):
    assert values(spark, ["  Xin CHÀO \n bạn ", " "], T.tokens("t")) == [["xin", "chào", "bạn"], []]


def test_unquoted_line(spark):
    assert values(spark, ["a, b\\c"], T.encode_unquoted("t", F.lit(2))) == ["a\\, b\\\\c,2"]
    assert values(spark, ["a\\, b\\\\c,2", "x", "a\\\\\\,b\\\\,c"], T.decode_unquoted("t")) == [
        ["a, b\\c", "2"], ["x"], ["a\\,b\\", "c"],
    ]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='ab,\\"\n\rnrcqbé ', max_size=30), min_size=1, max_size=40))
def test_unquoted_round_trip(spark, texts):
    line = T.encode_unquoted("t", F.lit(1))
    assert values(spark, texts, T.decode_unquoted(line)) == [[t, "1"] for t in texts]
    assert not any("\n" in x or "\r" in x for x in values(spark, texts, line))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from(T.WHITESPACE + "ab" + chr(0x200B)), max_size=20), min_size=1, max_size=40))
def test_white_space_like_python(spark, texts):
    assert values(spark, texts, T.strip_text("t")) == [t.strip() for t in texts]
    assert values(spark, texts, T.collapse_whitespace("t")) == [" ".join(t.split()) for t in texts]
    assert values(spark, texts, T.tokens("t")) == [t.lower().split() for t in texts]
