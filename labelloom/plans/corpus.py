"""From sources to the final corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import constants as C
from labelloom.functions import text as T
from labelloom.operators.generated import parse_generated_lines
from labelloom.operators.quota import KEYS, accept_to_quota, progress, remaining_quota
from labelloom.operators.splits import assign_ids
from labelloom.operators.tables import combine_sources, map_label_words
from labelloom.sources.csv import with_parsed_label


def clean_sentences(df: DataFrame, label_words: bool = False) -> DataFrame:
    """Sentences without quotes; label words become codes on request."""
    cleaned = df.withColumn("sentence", T.remove_quotes("sentence"))
    return map_label_words(cleaned) if label_words else cleaned


def fill_categories(
    responses: DataFrame,
    categories: DataFrame,
    sink: DataFrame | None,
    arrival: Sequence[str],
    target: int = C.TARGET_PER_CATEGORY,
) -> DataFrame:
    """New rows ``(category, label, arrival..., line_no, sentence, sentiment)`` to append to the sink.

    ``responses`` holds ``category, label, response`` and the unique ``arrival`` columns.
    """
    done = progress(sink) if sink is not None else progress(categories.limit(0))
    remaining = remaining_quota(categories, done, target)
    lines = parse_generated_lines(responses, keep=[*KEYS, *arrival])
    return accept_to_quota(lines, remaining, [*arrival, "line_no"])


def final_corpus(raw: DataFrame) -> DataFrame:
    """Rows ``(split, id, text, class)`` from raw rows ``(split, pos, text, label)``."""
    return assign_ids(with_parsed_label(raw)).select("split", "id", "text", "class")


def combined_splits(**sources: DataFrame) -> DataFrame:
    """The processed sources as one table ``(source, split, sentence, sentiment)``."""
    columns = ["split", "sentence", F.col("sentiment").cast("int")]
    return combine_sources(**{name: df.select(*columns) for name, df in sources.items()})
