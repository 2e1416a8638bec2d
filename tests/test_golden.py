"""Pair counts of two published, line-aligned label files, if a copy is at hand."""

from __future__ import annotations

import os

import pytest

from labelloom.sources.lines import read_aligned_lines

FOLDER = os.environ.get("GOLDEN_LABELS_DIR")

# Lines per split, sentiment and topic 0 to 3.
GOLDEN = {
    ("train", "0"): (2909, 1716, 474, 226),
    ("train", "1"): (186, 101, 10, 161),
    ("train", "2"): (5071, 384, 13, 175),
    ("val", "0"): (405, 196, 69, 35),
    ("val", "1"): (32, 14, 1, 26),
    ("val", "2"): (714, 57, 0, 34),
    ("test", "0"): (791, 416, 138, 64),
    ("test", "1"): (74, 47, 2, 44),
    ("test", "2"): (1425, 109, 5, 51),
}


@pytest.mark.skipif(not FOLDER, reason="GOLDEN_LABELS_DIR is not set")
def test_golden_counts(spark):
    rows, status = read_aligned_lines(spark, FOLDER, {"sentiment": "sentiments.txt", "topic": "topics.txt"})
    counts = {(r.split, r.sentiment, r.topic): r["count"] for r in rows.groupBy("split", "sentiment", "topic").count().collect()}
    want = {(*key, str(t)): n for key, row in GOLDEN.items() for t, n in enumerate(row) if n}
    assert counts == want
    assert {r.split: r.most for r in status.collect()} == {"train": 11426, "val": 1583, "test": 3166}
