"""Cleaning, splitting and rendering of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom import constants as C

# Code points that count as white space at the ends of a text.
_SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
_SPACES += [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITESPACE = "".join(map(chr, _SPACES))
RUN_OF_WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c: Column | str) -> Column:
    """Remove Unicode white space from both ends."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def collapse_whitespace(c: Column | str) -> Column:
    """Every run of white space becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(_col(c), RUN_OF_WHITESPACE, " "))


def remove_quotes(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit('"'), F.lit(""))


def clean_answer(c: Column | str) -> Column:
    """A returned sentence, stripped and without quotes."""
    return remove_quotes(strip_text(c))


def after_last_comma(c: Column | str) -> Column:
    return F.substring_index(_col(c), ",", -1)


def before_last_comma(c: Column | str) -> Column:
    """Text before the last comma. Meant for texts that hold one."""
    c = _col(c)
    return F.substring(c, F.lit(1), F.length(c) - F.length(after_last_comma(c)) - 1)


def has_sentence_length(c: Column | str, low: int = C.MIN_CHARS, high: int = C.MAX_CHARS) -> Column:
    return F.length(_col(c)).between(low, high)


def category_key(category: Column | str, label: Column | str) -> Column:
    return F.concat_ws("_", _col(category), _col(label).cast("string"))


def paraphrase_request(sentence: Column | str, name: Column | str) -> Column:
    """The request text for one sentence; NULL for a NULL sentence."""
    sentence = _col(sentence)
    return F.when(sentence.isNotNull(), F.format_string(C.PARAPHRASE_REQUEST, _col(name), sentence))


def tokens(c: Column | str) -> Column:
    """Lower-case words between white space."""
    return F.array_remove(F.split(F.lower(_col(c)), RUN_OF_WHITESPACE), "")


def first_tokens(c: Column | str, n: int) -> Column:
    """The first ``n`` of :func:`tokens`; the rest of a text is not taken apart."""
    parts = F.split(F.regexp_replace(F.lower(_col(c)), f"^{RUN_OF_WHITESPACE}", ""), RUN_OF_WHITESPACE, n + 1)
    return F.array_remove(F.slice(parts, 1, n), "")


# Escapes of the unquoted line format, as (character, written form).
_ESCAPES = [("\\", "\\\\"), (",", "\\,"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")]
_NULL = "\\N"
# While a line is taken apart, these stand for an escaped backslash, comma and quote.
_MARKS = [("\\\\", "\\b"), ("\\,", "\\c"), ('\\"', "\\q")]
_UNMARK = [("\\c", ","), ("\\q", '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\\")]


def _replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def encode_unquoted(*cols: Column | str) -> Column:
    """One line without quotes: fields joined by commas, special characters escaped by a backslash, NULL as ``\\N``."""
    fields = [F.coalesce(_replace_all(_col(c).cast("string"), _ESCAPES), F.lit(_NULL)) for c in cols]
    return F.concat_ws(",", *fields)


def decode_unquoted(line: Column | str) -> Column:
    """Fields of a line made by :func:`encode_unquoted`.

    The escapes are first turned into marks without a comma, so a plain split finds the field ends
    and no regular expression has to walk a whole text.
    """
    fields = F.split(_replace_all(_col(line), _MARKS), ",")
    return F.transform(fields, lambda f: F.when(f != _NULL, _replace_all(f, _UNMARK)))
