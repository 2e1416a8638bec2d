"""Vocabulary and fixed-length encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom import constants as C
from labelloom.functions import text as T
from labelloom.operators.joins import broadcast_if_small, is_small
from labelloom.staging import stage

# Words of a large vocabulary that are looked up by broadcast.
_HOT = 10_000
# Hash buckets per word of a vocabulary, and buckets per word whose words are counted first.
_BUCKETS, _FULLEST = 32, 2
# Bucket numbers that are broadcast; they are at most _BUCKETS for each word of the vocabulary, whatever the text.
_SENT_ROWS, _SENT_BYTES = 4_000_000, 64 << 20


def build_vocab(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Rows ``(token, n, id)``: the ``size`` most frequent words, ties by word, ids from 4 up.

    Not every distinct word is shuffled. Words are first counted by hash bucket, ``_BUCKETS`` for each word of the
    vocabulary; what a bucket holds is an upper bound for each of its words. Only the words of the fullest buckets are
    then counted one by one. If ``size`` of them occur as often as the emptiest of these buckets says, no other word can
    belong to the vocabulary. Otherwise ``size`` words are known to occur so and so often, and words of all buckets that hold as
    many are counted once more, which is enough. The result, at most ``size`` rows, is written to the shared folder, so
    that encoding does not count the words again.
    """
    words = df.select(F.explode(T.tokens(text)).alias("token"))
    words = words.withColumn("_bucket", F.pmod(F.xxhash64("token"), F.lit(_BUCKETS * max(size, 1))))
    held = stage(words.groupBy("_bucket").agg(F.count("*").alias("n")), "word-buckets")
    least = _nth_largest(held, _FULLEST * size)
    counts = _counted(words, held, least)
    surely = _nth_largest(counts, size)
    if surely < least:
        counts = _counted(words, held, surely)
        surely = _nth_largest(counts, size)
    order = [F.desc("n"), F.asc("token")]
    top = counts.filter(F.col("n") >= surely).orderBy(*order).limit(size)
    number = F.row_number().over(Window.orderBy(*order)) + F.lit(C.FIRST_TOKEN_ID - 1)
    return stage(top.select("token", "n", number.cast("int").alias("id")), "vocab")


def _nth_largest(counts: DataFrame, k: int) -> int:
    """The ``k``-th largest ``n``, or 1 where there are fewer rows."""
    # a row per frequency: far fewer than words
    upto = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    running = counts.groupBy("n").agg(F.count("*").alias("_rows")).withColumn("_upto", F.sum("_rows").over(upto))
    return running.filter(F.col("_upto") >= k).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]


def _counted(words: DataFrame, held: DataFrame, least: int) -> DataFrame:
    """How often each word of the buckets that hold ``least`` words or more occurs."""
    full = broadcast_if_small(held.filter(F.col("n") >= least).select("_bucket"), _SENT_ROWS, _SENT_BYTES)
    return stage(words.join(full, "_bucket", "left_semi").groupBy("token").agg(F.count("*").alias("n")), "word-counts")


def _with_ids(exploded: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add the ``id`` of each token. In a vocabulary too large to broadcast, the ``_HOT`` most frequent words, which most
    rows hold, are still looked up by broadcast, and only the others are shuffled."""
    vocab = vocab.select("token", "id")
    if is_small(vocab):
        return exploded.join(F.broadcast(vocab), "token", "left")
    first = F.col("id") < C.FIRST_TOKEN_ID + _HOT
    hot = exploded.join(F.broadcast(vocab.filter(first)), "token", "left")
    unknown = F.col("id").isNull() & F.col("token").isNotNull()
    cold = hot.filter(unknown).drop("id").join(vocab.filter(~first), "token", "left")
    return hot.filter(~unknown).unionByName(cold)


def encode_fixed(
    df: DataFrame,
    vocab: DataFrame,
    key: Sequence[str],
    max_len: int = C.MAX_LEN,
    text: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows ``(key..., keep..., input_ids, attention_mask)``: start mark, word ids, end mark, padding.

    ``key`` is unique. Rows are spread by key once, as arrays already cut to length; the words found
    in a broadcast vocabulary are then gathered again without a further shuffle.
    """
    words = T.first_tokens(text, max_len - 2)
    rows = df.select(*key, *keep, F.coalesce(words, F.array().cast("array<string>")).alias("_words")).repartition(*key)
    exploded = rows.select(*key, *keep, F.posexplode_outer("_words").alias("_at", "token"))
    found = _with_ids(exploded, vocab)
    token_id = F.when(F.col("token").isNotNull(), F.coalesce("id", F.lit(C.UNKNOWN_ID)))
    entry = F.when(token_id.isNotNull(), F.struct("_at", token_id.alias("id")))
    gathered = found.groupBy(*key).agg(
        F.array_sort(F.collect_list(entry)).alias("_entries"), *[F.any_value(k).alias(k) for k in keep]
    )
    ids = F.transform("_entries", lambda e: e["id"])
    used = F.size("_entries") + 2
    pads = F.lit(max_len) - used
    input_ids = F.concat(
        F.array(F.lit(C.START_ID)), ids, F.array(F.lit(C.END_ID)), F.array_repeat(F.lit(C.PAD_ID), pads)
    )
    mask = F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), pads))
    return gathered.select(*key, *keep, input_ids.alias("input_ids"), mask.alias("attention_mask"))
