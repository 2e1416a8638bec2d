"""Secrets in texts, with DataFrame functions only.

Base kinds are patterns. The method adds strings whose characters are as mixed as those of random
keys: Shannon entropy in a window that slides over each candidate string, with a limit for each
character class of the window, so that a hexadecimal key is also found behind ``key=`` or ``v1/``.
The counts of all characters in the window, those of its digits and of its hexadecimal letters, and
the sum of c * log2(c) over the counts c are carried from place to place: a step takes one character
out and one in, so only their two counts change. The sum is in whole millionths, so results do not
depend on the order of floating-point sums. Strings on the allow list and spans inside base ones are
not reported.

No array grows step by step: places and largest ends so far come from running totals that double
their reach, so a text costs about as much as it is long, however many secrets are in it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import whole_text

#: Fixed patterns of the base kinds, and how they are matched: kind, words of either case, pattern, group to measure, least length.
_WORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = f"({'|'.join(map(_either_case, _WORDS))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
LEAST_ASSIGNED = 8
#: Order of kinds among spans with equal starts.
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates for the entropy scan, the window, and the least bits per character by class: hexadecimal, any other.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: All characters of candidates: digits, hexadecimal letters, others.
DIGITS, HEX_LETTERS = "0123456789", "ABCDEFabcdef"
ALPHABET = DIGITS + HEX_LETTERS + "GHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz+/_=-"
WINDOW = 20
HEX_BITS, OTHER_BITS = 3.0, 3.7
#: Strings that are no secrets however mixed: no digit or no letter, one case of letters between dashes or slashes (paths,
#: slugs, identifiers), and well-known runs of characters.
ALLOWED = (
    "^[^0-9]*$",
    "^[^A-Za-z]*$",
    "^[0-9]*[a-z_]+[0-9]*([/_=+-]+[0-9]*[a-z_]*[0-9]*)*$",
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]",
    "abcdefghijklmnop",
    "ABCDEFGHIJKLMNOP",
    "0123456789",
    "^sha(256|384|512)-",
)
#: The third of them for Java's engine, which goes back in the repeated group, to the cube of the length, and recurses into
#: it: the same strings, with one way to match each. A first "_" counts as a letter where no letter is before it.
ONE_WAY = {ALLOWED[2]: "^(?:[0-9]*+[a-z]++|[0-9]*+_[a-z]*+)[0-9]*+(?:[/_=+-]++[0-9]*+[a-z]*+[0-9]*+)*+$"}
#: A window of digits and letters that are all hexadecimal has the limit of hexadecimal candidates, whatever is around it.
#: Digits alone, like numbers behind a prefix, do not.
HEX_CLASS = "^[0-9A-Fa-f]+$"
MARK = "[SECRET]"
#: Characters of the pieces that a text is cut into for masking.
PIECE = 4096


def _scaled(c: int) -> int:
    return round(c * math.log2(c) * 1_000_000) if c else 0


#: c * log2(c) in millionths for counts 0 .. WINDOW, and the largest sum that still has so many bits per character.
TERMS = [_scaled(c) for c in range(WINDOW + 1)]


def most_sum(bits: float) -> int:
    return round(WINDOW * (math.log2(WINDOW) - bits) * 1_000_000)


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: inside a lambda, a variable is read, an expression evaluated again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, combine) -> Column:
    """Running totals of an array under an associative ``combine``: each round adds what lies 1, 2, 4, ... places before."""
    reach = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(values))

    def round_of(totals: Column, d: Column) -> Column:
        before = lambda x, i: F.when(i >= d, combine(x, F.get(totals, i - d))).otherwise(x)
        return F.transform(totals, before)

    return F.aggregate(reach, values, round_of)


def _places(text: Column, pattern: str) -> Column:
    """``start, end, found`` of all matches, leftmost first: the gaps between them, from a split, give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    # most texts have no match, and are then not split
    gaps = F.when(F.size(found) > 0, F.split(text, pattern, -1))

    def with_ends(both: Column) -> Column:
        gaps = F.slice(both["gaps"], 1, F.size(both["found"]))
        lengths = F.zip_with(both["found"], gaps, lambda f, g: F.length(f) + F.length(g))
        return _with(lengths, lambda n: F.zip_with(both["found"], _running(n, lambda x, y: x + y), place))

    def place(f: Column, end: Column) -> Column:
        return F.struct((end - F.length(f)).alias("start"), end.alias("end"), f.alias("found"))

    return _with(found, lambda f: F.when(F.size(f) > 0, _with(F.struct(f.alias("found"), gaps.alias("gaps")), with_ends)).otherwise(none))


def _mixed_part(place: Column) -> Column:
    """From the first to the last window of a candidate with enough bits, or null."""
    codes = F.transform(F.split(place["found"], ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    known = F.struct(
        codes.alias("codes"), place["found"].rlike(HEX_CLASS).alias("hex"), place["start"].alias("start"),
        F.array(*[F.lit(t) for t in TERMS]).alias("terms"),
    )
    return _with(known, _mixed_span)


def _mixed_span(known: Column) -> Column:
    codes, terms = known["codes"], known["terms"]
    zero = F.struct(
        F.lit(0).alias("sum"), F.lit(0).alias("digits"), F.lit(0).alias("letters"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )
    term = lambda n: F.element_at(terms, n + 1)
    is_digit = lambda c: c.between(1, len(DIGITS)).cast("int")
    is_letter = lambda c: c.between(len(DIGITS) + 1, len(DIGITS + HEX_LETTERS)).cast("int")

    def step(state: Column, i: Column) -> Column:
        # one character comes in, and from the first full window on one leaves; 0 stands for none
        leaving = F.when(i > WINDOW, F.element_at(codes, F.greatest(i - WINDOW, F.lit(1)))).otherwise(0)
        return _with(F.struct(F.element_at(codes, i).alias("into"), leaving.alias("out")), lambda c: moved(state, i, c["into"], c["out"]))

    def moved(state: Column, i: Column, into: Column, out: Column) -> Column:
        counts = state["counts"]
        more, less = F.element_at(counts, into), F.element_at(counts, F.greatest(out, F.lit(1)))
        change = term(more + 1) - term(more) + F.when(out > 0, term(less - 1) - term(less)).otherwise(0)
        shifted = F.transform(counts, lambda n, j: n + (j + 1 == into).cast("int") - (j + 1 == out).cast("int"))
        return _with(
            F.struct(
                F.when(into == out, state["sum"]).otherwise(state["sum"] + change).alias("sum"),
                (state["digits"] + is_digit(into) - is_digit(out)).alias("digits"),
                (state["letters"] + is_letter(into) - is_letter(out)).alias("letters"),
            ),
            lambda now: judged(state, i, now, F.when(into == out, counts).otherwise(shifted)),
        )

    def judged(state: Column, i: Column, now: Column, counts: Column) -> Column:
        of_hex = known["hex"] | ((now["digits"] > 0) & (now["letters"] > 0) & (now["digits"] + now["letters"] == WINDOW))
        most = F.when(of_hex, most_sum(HEX_BITS)).otherwise(most_sum(OTHER_BITS))
        hot = (i >= WINDOW) & (now["sum"] <= most)
        return F.struct(
            now["sum"].alias("sum"), now["digits"].alias("digits"), now["letters"].alias("letters"), counts.alias("counts"),
            F.coalesce(state["first"], F.when(hot, i - WINDOW)).alias("first"),
            F.when(hot, i).otherwise(state["last"]).alias("last"),
        )

    def finish(w: Column) -> Column:
        return F.when(w["first"].isNotNull(), _span(known["start"] + w["first"], 3, known["start"] + w["last"]))

    return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, finish)


def _span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("k"), F.lit(KINDS[kind]).alias("kind"), end.alias("end"))


def _kept(places: Column, kind: int) -> Column:
    return F.transform(places, lambda p: _span(p["start"], kind, p["end"]))


def _not_inside(spans: Column) -> Column:
    """Sorted spans without those by entropy that lie inside a base one: one that starts no later and ends no earlier.

    Base spans come first among equal starts, so the largest base end up to a span tells.
    """
    ends = F.transform(spans, lambda s: F.when(s["k"] < 3, s["end"]).otherwise(0))
    marked = lambda s, most: F.when((s["k"] < 3) | (most < s["end"]), s)
    kept = _with(ends, lambda e: F.zip_with(spans, _running(e, F.greatest), marked))
    return F.filter(kept, lambda s: s.isNotNull())


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``_secrets``: ``start, k, kind, end`` of every span, by start, then kind.

    Places are code points, ends exclusive. Null and empty texts have no spans. Spans of different kinds may overlap;
    those of one kind do not. Repeated rows are scanned alike. An existing ``_secrets`` is replaced; other columns are kept
    whatever their names. An empty table stays empty.
    """
    own = [c for c in docs.columns if c != "_secrets"]
    rows = docs.select(F.struct(*own).alias("_row"), whole_text(docs, text).alias("_text"))
    t = F.col("_text")
    long_enough = lambda p: F.length(F.regexp_extract(p["found"], ASSIGN, 2)) >= LEAST_ASSIGNED
    base = F.concat(_kept(F.filter(_places(t, ASSIGN), long_enough), 0), _kept(_places(t, ACCESS), 1), _kept(_places(t, HEX), 2))
    rows = rows.withColumns({"_base": base, "_found": _places(t, CANDIDATE)})

    def suspicious(p: Column) -> Column:
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | p["found"].rlike(ONE_WAY.get(pattern, pattern))
        return ~allowed

    mixed = F.filter(F.transform(F.filter("_found", suspicious), _mixed_part), lambda s: s.isNotNull())
    rows = rows.withColumn("_mixed", F.when(F.size("_found") > 0, mixed))
    spans = F.when(F.size("_mixed") > 0, _with(F.array_sort(F.concat("_base", "_mixed")), _not_inside)).otherwise(F.array_sort("_base"))
    return rows.select(*[F.col("_row")[c].alias(c) for c in own], spans.alias("_secrets"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every stretch of the text that spans cover replaced by ``MARK``; null texts stay null."""
    found = scanned(docs, text)
    t = F.col(text)
    ends = F.transform("_secrets", lambda s: s["end"])
    known = F.struct(
        F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), F.col("_secrets").alias("spans"),
        _with(ends, lambda e: _running(e, F.greatest)).alias("upto"),
    )
    return found.withColumn(text, F.when(F.size("_secrets") > 0, _with(known, _masked)).otherwise(t)).drop("_secrets")


def _masked(known: Column) -> Column:
    """The text outside ``spans``, given in ``pieces``, and a mark for each stretch; ``upto`` is the largest end so far."""
    pieces, upto = known["pieces"], known["upto"]

    def between(a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        tail = F.substring(F.get(pieces, first), a % PIECE + 1, F.lit(PIECE))
        head = F.substring(F.coalesce(F.get(pieces, last), F.lit("")), F.lit(1), b % PIECE)
        whole = F.array_join(F.slice(pieces, first + 2, last - first - 1), "")
        one = F.substring(F.get(pieces, first), a % PIECE + 1, b - a)
        return F.when(a >= b, "").when(first == last, one).otherwise(F.concat(tail, whole, head))

    def part(s: Column, i: Column) -> Column:
        at = F.coalesce(F.get(upto, i - 1), F.lit(0))
        return F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.lit(MARK))).otherwise("")

    n_chars = F.aggregate(pieces, F.lit(0), lambda n, p: n + F.length(p))
    rest = between(F.element_at(upto, -1), n_chars)
    return F.concat(F.array_join(F.transform(known["spans"], part), ""), rest)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans."""
    of = lambda k: F.filter("_secrets", lambda s: s["k"] == k)
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(listed(F.filter("_secrets", lambda s: s["k"] < 3)), 256).alias("base_sha256"),
        listed(F.col("_secrets")).alias("spans"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for :func:`digest` over ``documents``; windows are counted one by one instead of step by step."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def places(name: str, pattern: str) -> str:
        return f"""{name}_m AS (SELECT doc_id, regexp_extract_all(text, {quoted(pattern)}) AS m, string_split_regex(text, {quoted(pattern)}) AS g FROM d),
{name}_u AS (SELECT doc_id, unnest(m) AS found, unnest(g[:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM {name}_m WHERE len(m) > 0),
{name} AS (SELECT doc_id, found, (sum(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS stop,
           stop - length(found) AS start FROM {name}_u)"""

    allowed = " OR ".join(f"regexp_matches(found, {quoted(p)})" for p in ALLOWED)
    terms = ", ".join(map(str, TERMS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{places("a", ASSIGN)}, {places("k", ACCESS)}, {places("h", HEX)}, {places("c", CANDIDATE)},
base AS (SELECT doc_id, start, 0 AS k, 'assign' AS kind, stop FROM a WHERE length(regexp_extract(found, {quoted(ASSIGN)}, 2)) >= {LEAST_ASSIGNED}
         UNION ALL SELECT doc_id, start, 1, 'access', stop FROM k UNION ALL SELECT doc_id, start, 2, 'hex', stop FROM h),
s AS (SELECT * FROM c WHERE NOT ({allowed})),
w AS (SELECT doc_id, start, found, unnest(range(0, length(found) - {WINDOW - 1})) AS o, substring(found, o + 1, {WINDOW}) AS part FROM s),
x AS (SELECT doc_id, start, found, o, part, unnest(string_split(part, '')) AS ch FROM w),
n AS (SELECT doc_id, start, found, o, part, ch, count(*) AS n FROM x GROUP BY ALL),
e AS (SELECT doc_id, start, found, o, part, sum(([{terms}])[n + 1]) AS total FROM n GROUP BY ALL),
mixed AS (SELECT doc_id, start + min(o) AS start, 3 AS k, 'entropy' AS kind, start + max(o) + {WINDOW} AS stop FROM e
          WHERE total <= CASE WHEN regexp_matches(found, {quoted(HEX_CLASS)}) OR (regexp_matches(part, {quoted(HEX_CLASS)})
                AND regexp_matches(part, '[0-9]') AND regexp_matches(part, '[A-Fa-f]')) THEN {most_sum(HEX_BITS)} ELSE {most_sum(OTHER_BITS)} END
          GROUP BY doc_id, e.start),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM mixed m WHERE NOT EXISTS
          (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.start <= m.start AND m.stop <= b.stop)),
l AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3) AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN l USING (doc_id)
"""
