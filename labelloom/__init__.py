"""Labelled-text corpus engine: ingest, clean, label, cap, split, encode, fit, score and measure."""
