"""Label codes, words and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom import constants as C
from labelloom.functions.text import strip_text


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column | str, mapping: dict) -> Column:
    """Value of a small dictionary, NULL for anything that is not a key."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), _col(c))


def label_from_word(c: Column | str) -> Column:
    """Exact, case-sensitive word to code."""
    return lookup(c, C.LABEL_WORDS)


def label_name(c: Column | str, names: dict[int, str] = C.PROMPT_NAMES, default: str | None = C.PROMPT_DEFAULT) -> Column:
    named = lookup(c, names)
    return named if default is None else F.coalesce(named, F.lit(default))


def label_from_name(c: Column | str, names: dict[int, str] = C.OFFLINE_NAMES) -> Column:
    return lookup(c, {name: code for code, name in names.items()})


def parse_label(c: Column | str, default: int = C.DEFAULT_LABEL) -> Column:
    """Integer with optional sign and white space around it; anything else is ``default``.

    The pattern comes first because a cast that fails is slow.
    """
    text = strip_text(c)
    number = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
    return F.coalesce(number, F.lit(default))
