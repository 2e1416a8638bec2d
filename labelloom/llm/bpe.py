"""Byte-level BPE encoding and decoding by a prefix-sharing trie.

Texts are cut into words by the tokenizer's own pattern. The distinct words go into a trie of bytes,
held as the sorted list of words, and the trie is visited depth first. Every node has one state, the
last token of the encoding of its prefix; the rest of that encoding is the encoding of a shorter
prefix, so it is held by an ancestor. A prefix that many words share is thus encoded once. A token
ends a prefix if the merges leave it apart from the last token of what stands before it; exactly one
of the prefix's suffixes does.

Words never leave their task: no text is shuffled. Each Python worker remembers words up to a fixed
number, so its memory does not grow with the data.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelloom.llm.common import id_and_text, ship

#: Name of the vocabulary in the folder of public tokenizers, and the text of its special token.
VOCABULARY = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
#: Bounds of what a process remembers: words with their ids, and answers about pairs of tokens and tails of prefixes.
MAX_WORDS = 200_000
MAX_PAIRS = 200_000
#: Characters encoded together.
SLICE = 2_000_000
#: So many last bytes of a prefix are looked at to rule out token lengths.
TAIL = 4

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _other_numbers() -> str:
    """Numbers that are no decimal digits, as ranges for a character class."""
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl")]
    ranges: list[list[int]] = []
    for c in found:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def word_pattern() -> re.Pattern:
    """The byte-level tokenizer's word pattern, with Unicode's white space and numbers spelled out for ``re``."""
    number = _other_numbers()
    letters = f" ?[^\\W\\d_{number}]+"
    numbers = f" ?[\\d{number}]+"
    others = f" ?(?:[^\\w{_SPACE}]+|_+)+"
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d|{letters}|{numbers}|{others}|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Token bytes by id, ids by bytes, and merges, read from a tokenizers file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        symbols = byte_symbols()
        spelled = {bytes(symbols[c] for c in token): i for token, i in model["model"]["vocab"].items() if token != SPECIAL}
        self.special_id = next((t["id"] for t in model["added_tokens"] if t["content"] == SPECIAL), None)
        self.ids = spelled
        size = 1 + max([*spelled.values(), self.special_id or 0])
        self.bytes = [b""] * size
        for token, i in spelled.items():
            self.bytes[i] = token
        if self.special_id is not None:
            self.bytes[self.special_id] = SPECIAL.encode()
        #: By token: the rank of the merge that makes it (-1 for a byte) and the two tokens merged.
        self.made_at, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = (spelled[bytes(symbols[c] for c in part)] for part in (merge.split(" ") if isinstance(merge, str) else merge))
            token = spelled[self.bytes[left] + self.bytes[right]]
            self.merges[left, right] = rank
            self.made_at[token], self.left[token], self.right[token] = rank, left, right
        tails: dict[bytes, set[int]] = {}
        for token in spelled:
            if len(token) > TAIL:
                tails.setdefault(token[-TAIL:], set()).add(len(token))
        self._tails, self._lengths = tails, {}

    def lengths(self, tail: bytes) -> tuple[int, ...]:
        """Lengths that a token may have that ends in these bytes (the last TAIL of a prefix, or all of it), longest first."""
        known = self._lengths.get(tail)
        if known is None:
            short = {n for n in range(1, len(tail) + 1) if tail[-n:] in self.ids}
            known = tuple(sorted(self._tails.get(tail, set()) | short, reverse=True))
            if len(self._lengths) >= MAX_PAIRS:
                self._lengths.clear()
            self._lengths[tail] = known
        return known

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives just these two.

        The merges that made them are undone, latest first, along their common border. A merge across the border
        that ranks before the one undone would have come first; of equal ones the left comes first.
        """
        made_at, limit = self.made_at, len(self.merges)
        while True:
            if self.merges.get((left, right), limit) < limit:
                return False
            at_left, at_right = made_at[left], made_at[right]
            if at_left < 0 and at_right < 0:
                return True
            if at_left > at_right:
                left, limit = self.right[left], at_left
            else:
                right, limit = self.left[right], at_right + 1


class Trie:
    """Encodes sorted words: the trie of their prefixes, visited depth first.

    In sorted order a word's new prefixes are those past what it shares with the word before it, so the path from
    the root is all that has to be held: ``path[i]`` is the state of the prefix of ``i`` bytes.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.apart: dict[int, bool] = {}

    def _state(self, word: bytes, end: int, path: list[int]) -> int:
        """The last token of the encoding of ``word[:end]``, from the states of shorter prefixes."""
        vocabulary, apart = self.vocabulary, self.apart
        ids = vocabulary.ids
        for length in vocabulary.lengths(word[max(0, end - TAIL) : end]):
            start = end - length
            if start < 0:
                continue
            token = ids.get(word[start:end])
            if token is None:
                continue
            if not start:
                return token  # a prefix that is a token is encoded by it: its own merges lead there
            key = path[start] << 20 | token
            known = apart.get(key)
            if known is None:
                known = apart[key] = vocabulary.stay_apart(path[start], token)
            if known:
                return token
        raise ValueError("a byte without a token")

    def encode_sorted(self, words: list[bytes]) -> Iterator[list[int]]:
        """The encodings of sorted distinct words, each shared prefix worked out once."""
        if len(self.apart) > MAX_PAIRS:
            self.apart.clear()
        before, path, spelled, state = b"", [-1], self.vocabulary.bytes, self._state
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                path.append(state(word, end, path))
            tokens, end = [], len(word)
            while end:
                token = path[end]
                tokens.append(token)
                end -= len(spelled[token])
            tokens.reverse()
            yield tokens
            before = word


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encodes texts to ids, packed as little-endian unsigned 32-bit integers, and decodes them."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.trie = Trie(self.vocabulary)
        self.find_words = word_pattern().findall
        self.known: dict[str, bytes] = {}

    def _words(self, text: str) -> list[list[str]]:
        """The words of the stretches between special tokens."""
        if self.vocabulary.special_id is None or SPECIAL not in text:
            return [self.find_words(text)]
        return [self.find_words(part) for part in text.split(SPECIAL)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of texts. The special token's own text, as in the tokenizers library, is that token."""
        parts = [self._words(text) for text in texts]
        words = set().union(*[stretch for part in parts for stretch in part])
        new = words.difference(self.known)
        if len(self.known) + len(new) > MAX_WORDS:
            self.known, new = {}, words
        ordered = sorted(word.encode() for word in new)
        for word, ids in zip(ordered, self.trie.encode_sorted(ordered)):
            self.known[word.decode()] = pack(ids)
        get, mark = self.known.__getitem__, pack([self.vocabulary.special_id or 0])
        return [mark.join([b"".join(map(get, stretch)) for stretch in part]) for part in parts]

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD, as in the tokenizers library."""
        tokens = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.vocabulary.bytes.__getitem__, tokens)).decode("utf-8", "replace")


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in slices of about so many characters, each with the values of a text column; a longer text stands alone."""
    texts = batch.column(column).to_pylist()
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(text)
    yield batch.slice(start), texts[start:]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This process's codec for a vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every whole text: ``doc_id, ids`` (packed little-endian unsigned 32-bit).

    Null and empty texts give empty ids, repeated rows give repeated results, null ids stay null; other columns are
    not read, so their names do not matter. An empty table gives an empty table. Nothing is shuffled.
    """
    ship(docs.sparkSession)
    rows = id_and_text(docs, id_col, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for part, texts in slices(batch, 1):
                ids = pa.array(coder.encode_batch(texts), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add column ``text``, decoded from packed ids. Null ids count as none and give the empty text."""
    ship(encoded.sparkSession)
    rows = encoded.select("doc_id", encoded[ids].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts = pa.array([coder.decode(i.as_py() or b"") for i in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=["doc_id", "ids", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, text string")
