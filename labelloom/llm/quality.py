"""Quality rules whose thresholds come from the corpus: quantile sketches per language and source.

Every document gets a few whole-number signals. Their distributions are summarised per language and
source by log-linear histograms: a value keeps its first 7 binary digits, so a quantile is known to
within 1/64, any two sketches merge by adding counts, and the result does not depend on the order of
merging. A threshold lies some interquartile ranges beyond a quartile, so it follows each source, and
a corpus without outliers loses nothing. Quartiles do not move to the outliers while those are fewer
than a quarter of a group. A group's threshold is averaged with its language's, the latter counting
as ``PRIOR`` documents, which makes sketches of small groups harmless without any switch by size.
The thresholds, one row per group, are then joined back and filter the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import free_unused, ship, whole_text
from labelloom.operators.joins import broadcast_if_small, join_null_safe
from labelloom.staging import stage

#: Base rule: fewer words, or a larger share of repeated words in a hundred, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: How many interquartile ranges a threshold lies beyond its quartile, and documents that a language's threshold counts as.
REACH, PRIOR = 3, 500
#: Signals held below a threshold, with the least distance between quartile and threshold: symbols in 10,000 characters
#: of words, characters in 100 words, repeated lines in 10,000 lines, repeated words in 10,000 words. The last entry
#: is the only one held above a lower threshold too.
SLACK = {"symbols": 300, "repeated_lines": 5000, "repeated_words": 4000, "word_length": 100}
TWO_SIDED = "word_length"

_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def text_counts(text: str) -> tuple[int, ...]:
    """Words, characters in words, symbols, repeated lines, words in repeated 3-word windows, and lines with a word."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        codes: dict[tuple, int] = {}
        at = np.fromiter((codes.setdefault(w, len(codes)) for w in windows), np.int64, len(windows))
        twice = np.bincount(at)[at] > 1
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : i + len(twice)] |= twice
        repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS]))
def _counts(texts: pa.Array) -> pa.Array:
    found = np.array([text_counts(t.as_py()) for t in texts], np.int64).reshape(len(texts), len(_COUNTS))
    free_unused()
    return pa.StructArray.from_arrays([pa.array(column) for column in found.T], names=list(_COUNTS))


def signals(c: Column) -> dict[str, Column]:
    """Whole-number signals of a struct of counts."""
    per = lambda part, whole, by: F.floor(by * c[part] / F.greatest(c[whole], F.lit(1))).cast("long")
    return {
        "symbols": per("n_symbols", "word_chars", 10_000),
        "repeated_lines": per("n_dup_lines", "n_lines", 10_000),
        "repeated_words": per("n_repeat_words", "n_words", 10_000),
        "word_length": per("word_chars", "n_words", 100),
    }


def bucket_of(value: Column) -> Column:
    """The smallest value with the same first 7 binary digits and the same number of them."""
    cut = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketches(measured: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """``groups, signal, bucket, n``: a histogram per group and signal over all documents with a word."""
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), bucket_of(F.col(f"_s.{s}")).alias("bucket")) for s in SLACK])
    rows = measured.filter("_c.n_words > 0").select(*groups, F.explode(pairs).alias("_p"))
    return rows.groupBy(*groups, "_p.signal", "_p.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Sketches of larger groups: counts added up."""
    return sketch.groupBy(*groups, "signal", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """``groups, signal, size, low, high``: thresholds from the quartiles of each sketch, in whole numbers."""
    group = Window.partitionBy(*groups, "signal")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(group)})
    quartile = lambda k: F.min(F.when(4 * F.col("_upto") >= k * F.col("_all"), F.col("bucket")))
    found = ranked.groupBy(*groups, "signal").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("_all").alias("size"))
    slack = F.create_map(*[F.lit(x) for item in SLACK.items() for x in item])[F.col("signal")]
    away = REACH * (F.col("q3") - F.col("q1")) + slack
    return found.select(*groups, "signal", "size", (F.col("q1") - away).alias("low"), (F.col("q3") + away).alias("high"))


def thresholds(measured: DataFrame, language: str, source: str) -> DataFrame:
    """One row per language and source: ``_low`` and ``_high``, structs with a threshold for each signal."""
    sketch = stage(sketches(measured, (language, source)), "sketches")
    wide = fences(merged(sketch, (language,)), (language,)).withColumnsRenamed({"size": "_n", "low": "_l", "high": "_h"})
    both = join_null_safe(fences(sketch, (language, source)), wide, [language, "signal"])
    mean = lambda own, other: F.floor((F.col("size") * F.col(own) + PRIOR * F.col(other)) / (F.col("size") + PRIOR))
    one = lambda value, s: F.max(F.when(F.col("signal") == s, value)).cast("long").alias(s)
    table = both.groupBy(language, source).agg(
        *[one(mean("low", "_l"), s).alias(f"_low_{s}") for s in SLACK], *[one(mean("high", "_h"), s).alias(f"_high_{s}") for s in SLACK]
    )
    return stage(table, "thresholds")


def judged(docs: DataFrame, language: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``_quality``: a struct of the counts, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows. ``kept``: not failed, and no
    signal beyond the thresholds of the row's language and source; a value equal to a threshold passes. Null languages
    and sources are groups like others. Null, empty and wordless texts have counts of 0 and fail. Repeated rows are judged
    alike and count as often as they occur. An existing ``_quality`` is replaced. An empty table stays empty.
    """
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c != "_quality"]

    def measured(rows: DataFrame) -> DataFrame:
        # all other columns pass by Python; the counts are cheap enough to be worked out for both passes
        counted = rows.withColumn("_c", _counts(whole_text(rows, "_text")))
        return counted.withColumn("_s", F.struct(*[v.alias(k) for k, v in signals(F.col("_c")).items()]))

    keys = [F.col(language).alias("_lang"), F.col(source).alias("_source")]
    keys = [F.col(text).alias("_text"), *keys]
    limits = thresholds(measured(docs.select(*keys)), "_lang", "_source")
    rows = measured(docs.select(F.struct(*own).alias("_row"), *keys))  # so that no column of theirs meets one of ours
    rows = join_null_safe(rows, broadcast_if_small(limits), ["_lang", "_source"], "left")
    c = F.col("_c")
    failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
    within = F.col(f"_s.{TWO_SIDED}") >= F.col(f"_low_{TWO_SIDED}")
    for s in SLACK:
        within = within & (F.col(f"_s.{s}") <= F.col(f"_high_{s}"))
    verdict = [failed.alias("base_failed"), (~failed & F.coalesce(within, F.lit(False))).alias("kept")]
    return rows.select(*[F.col("_row")[c].alias(c) for c in own], F.struct(*[c[n].alias(n) for n in _COUNTS], *verdict).alias("_quality"))


def oracle_sql() -> str:
    """DuckDB SQL for ``doc_id``, the base counts and both verdicts over ``documents``."""
    lines = ", ".join(f"('{s}', {v})" for s, v in SLACK.items())
    beyond = " OR ".join(f"(signal = '{s}' AND v > high)" for s in SLACK)
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
t AS (SELECT doc_id, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM t WHERE z IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, x, y, z) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS k FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(k, 0) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN rep USING (doc_id)),
s AS (SELECT *, 10000 * n_symbols // greatest(word_chars, 1) AS symbols, 10000 * n_dup_lines // greatest(n_lines, 1) AS repeated_lines,
             10000 * n_repeat_words // greatest(n_words, 1) AS repeated_words, 100 * word_chars // greatest(n_words, 1) AS word_length FROM c),
v AS (UNPIVOT (SELECT doc_id, lang, source, n_words, {", ".join(SLACK)} FROM s) ON {", ".join(SLACK)} INTO NAME signal VALUE v),
b AS (SELECT lang, source, signal, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket FROM v WHERE n_words > 0),
g AS (SELECT lang, source, signal, bucket, count(*) AS n FROM b GROUP BY ALL),
l AS (SELECT lang, signal, bucket, sum(n) AS n FROM g GROUP BY ALL),
gq AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, signal ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, signal) AS al FROM g),
lq AS (SELECT *, sum(n) OVER (PARTITION BY lang, signal ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, signal) AS al FROM l),
slack(signal, slack) AS (VALUES {lines}),
gf AS (SELECT lang, source, signal, max(al)::BIGINT AS size, min(bucket) FILTER (4 * upto >= al) AS q1, min(bucket) FILTER (4 * upto >= 3 * al) AS q3 FROM gq GROUP BY ALL),
lf AS (SELECT lang, signal, min(bucket) FILTER (4 * upto >= al) AS q1, min(bucket) FILTER (4 * upto >= 3 * al) AS q3 FROM lq GROUP BY ALL),
f AS (SELECT gf.lang, source, signal,
             floor((size * (gf.q1 - {REACH} * (gf.q3 - gf.q1) - slack) + {PRIOR} * (lf.q1 - {REACH} * (lf.q3 - lf.q1) - slack)) / (size + {PRIOR})) AS low,
             floor((size * (gf.q3 + {REACH} * (gf.q3 - gf.q1) + slack) + {PRIOR} * (lf.q3 + {REACH} * (lf.q3 - lf.q1) + slack)) / (size + {PRIOR})) AS high
      FROM gf JOIN lf USING (signal) JOIN slack USING (signal) WHERE gf.lang IS NOT DISTINCT FROM lf.lang),
bad AS (SELECT DISTINCT doc_id FROM v JOIN f USING (signal) WHERE v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source
        AND ({beyond} OR (signal = '{TWO_SIDED}' AND v < low))),
e AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM c)
SELECT e.doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept FROM e LEFT JOIN bad USING (doc_id)
"""
