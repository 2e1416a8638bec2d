"""Ids of whole texts for operators that only need them as a means, by the same vocabulary as :mod:`labelloom.llm.bpe`."""

from __future__ import annotations

import re

import numpy as np

from labelloom.llm.bpe import SPECIAL, Vocabulary

#: The word pattern of the vocabulary, fixed values. It differs from its short form only where a run of white space
#: stands before other characters; the short form needs no look-ahead and is faster.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_RUN = re.compile(r"\s\s(?=\S)")


class Encoder:
    """Encodes with the ``tiktoken`` library and the vocabulary of a ``tokenizers`` file; the ids are equal."""

    def __init__(self, path: str) -> None:
        import tiktoken

        vocabulary = Vocabulary(path)
        self.sizes = np.array([len(token) for token in vocabulary.bytes])
        self.special = {} if vocabulary.special_id is None else {SPECIAL: vocabulary.special_id}
        make = {"mergeable_ranks": vocabulary.ids, "special_tokens": self.special}
        self.full = tiktoken.Encoding("full", pat_str=PATTERN, **make)
        self.short = tiktoken.Encoding("short", pat_str=SHORT_PATTERN, **make)

    def ids(self, text: str) -> np.ndarray:
        encoding = self.full if _RUN.search(text) else self.short
        return encoding.encode_to_numpy(text, allowed_special=set(self.special), disallowed_special=())

    def plain_ids(self, text: str) -> np.ndarray:
        """Ids that take the special token's own text as ordinary text."""
        return (self.full if _RUN.search(text) else self.short).encode_to_numpy(text, disallowed_special=())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
